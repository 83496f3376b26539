"""Signature rules of the license scan, one by one: label | priority | keyword | pattern.

Patterns are over lower-case words with single spaces between them; the scan anchors both ends at word edges. They use
only what Java's and RE2's regular expressions share (no look-around, no back references, no possessive quantifiers).
The keyword is a literal that every match of the pattern contains.

Priorities: 100 identifiers, 90 notices with version and terms, 80 sentences of license texts, 70 names with versions,
60 addresses, 40 bare names, 20 general references.
"""

from __future__ import annotations

from typing import NamedTuple

#: Short literals, one of which every match contains: texts without any of them have no hit.
TRIGGERS = ("licen", "gnu", "gpl", "copyright", "software", "permission", "commons", "cc by", "cc0", "bsd", " mpl", " epl", "cddl", "eupl", "rights reserved", "public domain", "redistribution", "proprietary")

_TEXT = r"""
mit | 100 | identifier mit | spdx license identifier mit
mit-0 | 100 | identifier mit 0 | spdx license identifier mit 0
mit-cmu | 100 | identifier mit cmu | spdx license identifier mit cmu
apache-1.1 | 100 | identifier apache 1 | spdx license identifier apache 1 1
apache-2.0 | 100 | identifier apache 2 | spdx license identifier apache 2 0
apache-2.0-with-llvm-exception | 100 | llvm exception | spdx license identifier apache 2 0 with llvm exception
gpl-1.0 | 100 | identifier gpl 1 | spdx license identifier gpl 1 0
gpl-2.0 | 100 | identifier gpl 2 | spdx license identifier gpl 2 0
gpl-2.0-only | 100 | identifier gpl 2 | spdx license identifier gpl 2 0 only
gpl-2.0-or-later | 100 | identifier gpl 2 | spdx license identifier gpl 2 0 or later
gpl-2.0-with-classpath-exception | 100 | classpath exception | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception(?: 2 0)?
gpl-2.0-with-linux-syscall-note | 100 | linux syscall note | spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
gpl-3.0 | 100 | identifier gpl 3 | spdx license identifier gpl 3 0
gpl-3.0-only | 100 | identifier gpl 3 | spdx license identifier gpl 3 0 only
gpl-3.0-or-later | 100 | identifier gpl 3 | spdx license identifier gpl 3 0 or later
lgpl-2.0-or-later | 100 | identifier lgpl 2 0 | spdx license identifier lgpl 2 0 or later
lgpl-2.1 | 100 | identifier lgpl 2 1 | spdx license identifier lgpl 2 1
lgpl-2.1-only | 100 | identifier lgpl 2 1 | spdx license identifier lgpl 2 1 only
lgpl-2.1-or-later | 100 | identifier lgpl 2 1 | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | 100 | identifier lgpl 3 | spdx license identifier lgpl 3 0
lgpl-3.0-only | 100 | identifier lgpl 3 | spdx license identifier lgpl 3 0 only
lgpl-3.0-or-later | 100 | identifier lgpl 3 | spdx license identifier lgpl 3 0 or later
agpl-3.0 | 100 | identifier agpl | spdx license identifier agpl 3 0
agpl-3.0-only | 100 | identifier agpl | spdx license identifier agpl 3 0 only
agpl-3.0-or-later | 100 | identifier agpl | spdx license identifier agpl 3 0 or later
bsd-1-clause | 100 | identifier bsd 1 | spdx license identifier bsd 1 clause
bsd-2-clause | 100 | identifier bsd 2 | spdx license identifier bsd 2 clause
bsd-2-clause-patent | 100 | identifier bsd 2 | spdx license identifier bsd 2 clause patent
bsd-3-clause | 100 | identifier bsd 3 | spdx license identifier bsd 3 clause
bsd-3-clause-clear | 100 | identifier bsd 3 | spdx license identifier bsd 3 clause clear
bsd-4-clause | 100 | identifier bsd 4 | spdx license identifier bsd 4 clause
0bsd | 100 | identifier 0bsd | spdx license identifier 0bsd
isc | 100 | identifier isc | spdx license identifier isc
zlib | 100 | identifier zlib | spdx license identifier zlib
mpl-1.1 | 100 | identifier mpl 1 | spdx license identifier mpl 1 1
mpl-2.0 | 100 | identifier mpl 2 | spdx license identifier mpl 2 0
epl-1.0 | 100 | identifier epl 1 | spdx license identifier epl 1 0
epl-2.0 | 100 | identifier epl 2 | spdx license identifier epl 2 0
eupl-1.2 | 100 | identifier eupl | spdx license identifier eupl 1 2
cddl-1.0 | 100 | identifier cddl | spdx license identifier cddl 1 0
cc0-1.0 | 100 | identifier cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | 100 | identifier cc by 4 | spdx license identifier cc by 4 0
cc-by-sa-4.0 | 100 | identifier cc by sa | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | 100 | identifier cc by nc | spdx license identifier cc by nc 4 0
unlicense | 100 | identifier unlicense | spdx license identifier unlicense
boost-1.0 | 100 | identifier bsl | spdx license identifier bsl 1 0
artistic-2.0 | 100 | identifier artistic | spdx license identifier artistic 2 0
ofl-1.1 | 100 | identifier ofl | spdx license identifier ofl 1 1
wtfpl | 100 | identifier wtfpl | spdx license identifier wtfpl
postgresql | 100 | identifier postgresql | spdx license identifier postgresql
psf-2.0 | 100 | identifier psf | spdx license identifier psf 2 0
python-2.0 | 100 | identifier python | spdx license identifier python 2 0
ncsa | 100 | identifier ncsa | spdx license identifier ncsa
ms-pl | 100 | identifier ms pl | spdx license identifier ms pl
x11 | 100 | identifier x11 | spdx license identifier x11
gpl-1.0-or-later | 90 | any later version | gnu general public license as published by the free software foundation either version 1(?: of the license)? or at your option any later version
gpl-2.0-or-later | 90 | any later version | gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
gpl-3.0-or-later | 90 | any later version | gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl-2.0-only | 90 | version 2 of the license | gnu general public license as published by the free software foundation version 2 of the license
gpl-3.0-only | 90 | version 3 of the license | gnu general public license as published by the free software foundation version 3 of the license
gpl-2.0-only | 90 | gnu general public license version 2 | gnu general public license version 2(?: only)? as published by the free software foundation
gpl-3.0-only | 90 | gnu general public license version 3 | gnu general public license version 3(?: only)? as published by the free software foundation
lgpl-2.0-or-later | 90 | gnu library general public license | gnu library general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
lgpl-2.1-or-later | 90 | gnu lesser general public license | gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version
lgpl-3.0-or-later | 90 | gnu lesser general public license | gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
lgpl-2.1-only | 90 | gnu lesser general public license | gnu lesser general public license as published by the free software foundation version 2 1 of the license
agpl-3.0-or-later | 90 | gnu affero general public license | gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
agpl-3.0-only | 90 | gnu affero general public license | gnu affero general public license as published by the free software foundation version 3
apache-2.0 | 90 | licensed under the apache license | licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?
apache-2.0 | 90 | you may not use this file except | you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)?(?: www)? apache org licenses license 2 0
mpl-1.1 | 90 | mozilla public license | subject to the mozilla public license version 1 1
mpl-2.0 | 90 | mozilla public license | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
epl-1.0 | 90 | eclipse public license | made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2.0 | 90 | eclipse public license | made available under the terms of the eclipse public license v(?:ersion)? ?2 0
cddl-1.0 | 90 | common development and distribution license | subject to the terms of the common development and distribution license
mit | 90 | mit license | (?:licensed|released|distributed|available|published|provided) under the(?: terms of the)? mit license
bsd | 90 | bsd | (?:licensed|released|distributed|available|published|provided) under (?:a|the)(?: terms of the)? bsd(?: style)? license
gpl | 90 | gpl | (?:licensed|released|distributed|available|published|provided) under the(?: terms of the)?(?: gnu)? gpl
lgpl | 90 | lgpl | (?:licensed|released|distributed|available|published|provided) under the(?: terms of the)?(?: gnu)? lgpl
zlib | 90 | zlib license | (?:licensed|released|distributed|available|published|provided) under the(?: terms of the)? zlib license
boost-1.0 | 90 | boost software license | distributed under the boost software license version 1 0
psf-2.0 | 90 | licensed to psf | licensed to psf under a contributor agreement
unlicense | 90 | unlicense | (?:licensed|released|distributed|available|published|provided) under the(?: terms of the)? unlicense
cc-by | 90 | commons attribution | licensed under (?:a|the)(?: terms of the)? creative commons attribution(?: international)? license
cc-by-sa | 90 | commons attribution | licensed under (?:a|the)(?: terms of the)? creative commons attribution share ?alike(?: international)? license
mit | 80 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit | 80 | this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 80 | sublicense | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit-0 | 80 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc | 80 | permission to use copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 80 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | 80 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? (?:with or )?without fee is hereby granted
ntp | 80 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
postgresql | 80 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd | 80 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-source-code | 80 | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 80 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3-clause | 80 | endorse or promote | neither the name of [a-z0-9 ]{1,160} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 80 | endorse or promote | the names? of [a-z0-9 ]{1,160} may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 80 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear | 80 | licenses to any party s patent rights | no express or implied licenses to any party s patent rights are granted by this license
bsd-2-clause-patent | 80 | patent license | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable patent license
bsd | 80 | warrant | this software is provided by the (?:regents|author|authors|copyright holders) and contributors as is and any express or implied warranties
bsd | 80 | warrant | this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
mit | 80 | warrant | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | 80 | warrant | the software is provided as is and the author disclaims all warranties with regard to this software
zlib | 80 | warrant | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | 80 | permission is granted to anyone | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib-acknowledgement | 80 | copyright | an acknowledge?ment [a-z0-9 ]{1,160} copyright [a-z0-9 ]{1,80} in the product documentation is required
gpl | 80 | gnu general public license | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 80 | warranty | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl | 80 | gnu general public license along | you should have received a copy of the gnu general public license along with this program
gpl-2.0 | 80 | gnu general public license version 2 june | gnu general public license version 2 june 1991
gpl-3.0 | 80 | gnu general public license version 3 29 | gnu general public license version 3 29 june 2007
gpl-2.0 | 80 | license | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | 80 | license | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | 80 | welcome to redistribute | this is free software and you are welcome to redistribute it under certain conditions type show c for details
lgpl | 80 | lesser general public license | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2.0 | 80 | gnu library general public license | this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license
lgpl | 80 | gnu lesser general public license along | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
lgpl-2.1 | 80 | lesser general public license version 2 1 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | 80 | lesser general public license version 3 | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | 80 | affero general public license version 3 | gnu affero general public license version 3 19 november 2007
agpl | 80 | gnu affero general public license along | you should have received a copy of the gnu affero general public license along with this program
agpl | 80 | affero general public license is a free | the gnu affero general public license is a free copyleft license for software and other kinds of works
apache-2.0 | 80 | warranties or conditions of any kind | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | 80 | apache license version 2 0 january | apache license version 2 0 january 2004
apache-2.0 | 80 | copyright license | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | 80 | patent license | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license
apache-1.1 | 80 | permission | the names? apache(?: server)?(?: and apache software foundation)? must not be used to endorse or promote products derived from this software without prior written permission
apache-1.0 | 80 | apache group | this product includes software developed by the apache group for use in the apache http server project
mpl-2.0 | 80 | mozilla public license | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | 80 | secondary licenses | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1 | 80 | license | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations
epl | 80 | eclipse public license | the accompanying program is provided under the terms of this eclipse public license
epl-1.0 | 80 | this public license | the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this public license
cddl-1.0 | 80 | cddl | you can obtain a copy of the license at [a-z0-9 ]{1,120} cddl
cddl-1.0 | 80 | cddl header | cddl header start
unlicense | 80 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 80 | fuck | do what the fuck you want to public license
beerware | 80 | beer ware license | the beer ware license
boost-1.0 | 80 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
psf-2.0 | 80 | python software foundation license | python software foundation license version 2
psf-2.0 | 80 | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world ?wide license to reproduce analyze test perform
artistic-1.0 | 80 | copyright holder | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | 80 | license | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ofl-1.1 | 80 | sil open font license version 1 1 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 80 | open font license | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
cc0-1.0 | 80 | copyright and related | to the extent possible under law [a-z0-9 ]{1,160} has waived all copyright and related or neighboring rights to
cc0-1.0 | 80 | commons corporation is not a law firm | creative commons corporation is not a law firm and does not provide legal services distribution of this document does not create an attorney client relationship
cc-by-4.0 | 80 | attribution 4 0 international public license | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license
cc-by-sa-4.0 | 80 | 4 0 international public license | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution share ?alike 4 0 international public license
cc-by-nc-4.0 | 80 | 4 0 international public license | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution non ?commercial 4 0 international public license
ncsa | 80 | licen | university of illinois ncsa open source licen[sc]e
openssl | 80 | openssl toolkit | the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software without prior written permission
ms-pl | 80 | license | this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software
curl | 80 | permission to use copy modify | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
unicode-3.0 | 80 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation
ijg | 80 | permission is hereby granted | permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions
libpng-2.0 | 80 | permission is hereby granted | permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee subject to the following restrictions
icu | 80 | copyright notice s and this permission | provided that the above copyright notice s and this permission notice appear in all copies of the software
elastic-2.0 | 80 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features or functionality of the software
busl-1.1 | 80 | licensor hereby grants | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause | 80 | licensor | the software is provided to you by the licensor under the license as defined below subject to the following condition
gpl-1.0 | 70 | gpl | (?:gnu )?gpl(?: version)?(?: license)? v?1(?: 0)?
gpl-2.0 | 70 | gpl | (?:gnu )?gpl(?: version)?(?: license)? v?2(?: 0)?
gpl-3.0 | 70 | gpl | (?:gnu )?gpl(?: version)?(?: license)? v?3(?: 0)?
gpl-2.0 | 70 | gplv2 | gplv2(?: 0)?
gpl-3.0 | 70 | gplv3 | gplv3(?: 0)?
gpl-2.0-or-later | 70 | gplv2 | gplv2(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later | 70 | gplv3 | gplv3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-2.0-or-later | 70 | gpl | (?:gnu )?gpl(?: version)? v?2(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later | 70 | gpl | (?:gnu )?gpl(?: version)? v?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-2.0-only | 70 | gpl | (?:gnu )?gpl(?: version)? v?2(?: 0)? only
gpl-3.0-only | 70 | gpl | (?:gnu )?gpl(?: version)? v?3(?: 0)? only
gpl-2.0 | 70 | gpl | (?:gnu )?gpl(?: version)? v?2(?: 0)? (?:or|and)(?: gpl)?(?: version)? v?3(?: 0)?
gpl-3.0 | 70 | gpl | (?:gnu )?gpl(?: version)? v?2(?: 0)? (?:or|and)(?: gpl)?(?: version)? v?3(?: 0)?
gpl-2.0 | 70 | gnu general public license | gnu general public license(?: gpl)?(?: version)? v?2(?: 0)?
gpl-3.0 | 70 | gnu general public license | gnu general public license(?: gpl)?(?: version)? v?3(?: 0)?
gpl-2.0-or-later | 70 | gnu general public license | gnu general public license(?: gpl)?(?: version)? v?2(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later | 70 | gnu general public license | gnu general public license(?: gpl)?(?: version)? v?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-2.0-only | 70 | gnu general public license | gnu general public license(?: gpl)?(?: version)? v?2(?: 0)? only
gpl-3.0-only | 70 | gnu general public license | gnu general public license(?: gpl)?(?: version)? v?3(?: 0)? only
lgpl-2.0 | 70 | lgpl | (?:gnu )?lgpl(?: version)? v?2(?: 0)?
lgpl-2.1 | 70 | lgpl | (?:gnu )?lgpl(?: version)? v?2 1
lgpl-3.0 | 70 | lgpl | (?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgpl-2.1-or-later | 70 | lgpl | (?:gnu )?lgpl(?: version)? v?2 1 or (?:any )?(?:later|newer)(?: version)?
lgpl-3.0-or-later | 70 | lgpl | (?:gnu )?lgpl(?: version)? v?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
lgpl-2.1 | 70 | lesser general public license | (?:gnu )?lesser general public license(?: version)? v?2 1
lgpl-3.0 | 70 | lesser general public license | (?:gnu )?lesser general public license(?: version)? v?3(?: 0)?
lgpl-2.0 | 70 | library general public license | (?:gnu )?library general public license(?: version)? v?2(?: 0)?
agpl-3.0 | 70 | agpl | (?:gnu )?agpl(?: version)? v?3(?: 0)?
agpl-3.0 | 70 | affero general public license | (?:gnu )?affero general public license(?: version)? v?3(?: 0)?
agpl-3.0-or-later | 70 | affero general public license | (?:gnu )?affero general public license(?: version)? v?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
apache-1.0 | 70 | apache license | apache license(?: version)? v?1 0
apache-1.1 | 70 | apache license | apache license(?: version)? v?1 1
apache-2.0 | 70 | apache license | apache license(?: version)? v?2(?: 0)?
apache-1.1 | 70 | apache software license | apache software license(?: version)? v?1 1
apache-2.0 | 70 | apache software license | apache software license(?: version)? v?2(?: 0)?
apache-2.0 | 70 | license | apache 2(?: 0)? license
bsd-2-clause | 70 | bsd | (?:simplified bsd|freebsd|2 clause bsd|two clause bsd) licen[cs]e
bsd-3-clause | 70 | bsd | (?:new|modified|revised|bsd 3 clause|3 clause|three clause) bsd(?: license)?
bsd-3-clause | 70 | bsd 3 | bsd 3 clause(?: license)?
bsd-2-clause | 70 | bsd 2 | bsd 2 clause(?: license)?
bsd-4-clause | 70 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)(?: license)?
0bsd | 70 | bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: license)?
mpl-1.0 | 70 | mozilla public license | mozilla public license(?: mpl)?(?: version)? v?1 0
mpl-1.1 | 70 | mozilla public license | mozilla public license(?: mpl)?(?: version)? v?1 1
mpl-2.0 | 70 | mozilla public license | mozilla public license(?: mpl)?(?: version)? v?2(?: 0)?
mpl-1.1 | 70 | mpl | mpl(?: version)? v?1 1
mpl-2.0 | 70 | mpl | mpl(?: version)? v?2(?: 0)?
epl-1.0 | 70 | eclipse public license | eclipse public license(?: epl)?(?: version)? v?1(?: 0)?
epl-2.0 | 70 | eclipse public license | eclipse public license(?: epl)?(?: version)? v?2(?: 0)?
epl-1.0 | 70 | epl | epl(?: version)? v?1 0
epl-2.0 | 70 | epl | epl(?: version)? v?2 0
eupl-1.1 | 70 | eupl | eupl(?: version)? v?1 1
eupl-1.2 | 70 | eupl | eupl(?: version)? v?1 2
eupl-1.2 | 70 | european union public licen | european union public licen[cs]e(?: eupl)?(?: version)? v?1 2
cddl-1.0 | 70 | cddl | cddl(?: version)? v?1 0
cddl-1.1 | 70 | cddl | cddl(?: version)? v?1 1
artistic-1.0 | 70 | artistic license | artistic license(?: version)? v?1(?: 0)?
artistic-2.0 | 70 | artistic license | artistic license(?: version)? v?2(?: 0)?
osl-3.0 | 70 | open software license | open software license(?: osl)?(?: version)? v?3(?: 0)?
afl-3.0 | 70 | academic free license | academic free license(?: afl)?(?: version)? v?3(?: 0)?
boost-1.0 | 70 | boost software license | boost software license(?: version)? v?1(?: 0)?
ofl-1.1 | 70 | open font license | (?:sil )?open font license(?: ofl)?(?: version)? v?1 1
zpl-2.1 | 70 | zope public license | zope public license(?: zpl)?(?: version)? v?2 1
cpl-1.0 | 70 | common public license | common public license(?: cpl)?(?: version)? v?1 0
qpl-1.0 | 70 | public license | q public license(?: qpl)?(?: version)? v?1 0
cc0-1.0 | 70 | cc0 | cc0(?: version)? v?1 0(?: universal)?
cc-by-2.0 | 70 | cc by | cc by v?2 0
cc-by-3.0 | 70 | cc by | cc by v?3 0
cc-by-4.0 | 70 | cc by | cc by v?4 0
cc-by-sa-3.0 | 70 | cc by sa | cc by sa v?3 0
cc-by-sa-4.0 | 70 | cc by sa | cc by sa v?4 0
cc-by-nc-4.0 | 70 | cc by nc | cc by nc v?4 0
cc-by-nd-4.0 | 70 | cc by nd | cc by nd v?4 0
cc-by-nc-sa-4.0 | 70 | cc by nc sa | cc by nc sa v?4 0
cc-by-nc-nd-4.0 | 70 | cc by nc nd | cc by nc nd v?4 0
cc-by-3.0 | 70 | commons attribution | creative commons attribution(?: license)?(?: version)? 3 0(?: unported)?
cc-by-4.0 | 70 | commons attribution | creative commons attribution(?: license)?(?: version)? 4 0(?: international)?
cc-by-sa-3.0 | 70 | commons attribution | creative commons attribution share ?alike(?: license)?(?: version)? 3 0(?: unported)?
cc-by-sa-4.0 | 70 | commons attribution | creative commons attribution share ?alike(?: license)?(?: version)? 4 0(?: international)?
cc-by-nc-4.0 | 70 | commons attribution | creative commons attribution non ?commercial(?: license)?(?: version)? 4 0(?: international)?
cc-by-nd-4.0 | 70 | commons attribution | creative commons attribution no ?derivatives(?: license)?(?: version)? 4 0(?: international)?
cc-by-nc-sa-4.0 | 70 | commons attribution | creative commons attribution non ?commercial share ?alike(?: license)?(?: version)? 4 0(?: international)?
cc-by-nc-nd-4.0 | 70 | commons attribution | creative commons attribution non ?commercial no ?derivatives(?: license)?(?: version)? 4 0(?: international)?
gpl-2.0 | 60 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl-3.0 | 60 | gnu org licenses | gnu org licenses gpl 3 0(?: txt| html)?
gpl | 60 | gnu org licenses | gnu org licenses(?: gpl(?: txt| html)?)?
lgpl-2.1 | 60 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
lgpl-3.0 | 60 | gnu org licenses | gnu org licenses lgpl 3 0(?: txt| html)?
agpl-3.0 | 60 | gnu org licenses | gnu org licenses agpl 3 0(?: txt| html)?
apache-2.0 | 60 | apache org licenses | apache org licenses license 2 0(?: txt| html)?
mit | 60 | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)?
bsd-2-clause | 60 | opensource org licenses bsd | opensource org licenses bsd 2 clause
bsd-3-clause | 60 | opensource org licenses bsd | opensource org licenses bsd (?:3 clause|license(?: php)?)
mpl-2.0 | 60 | mpl 2 0 | mozilla org mpl 2 0
epl-1.0 | 60 | epl v10 | eclipse org legal epl v10(?: html)?
epl-2.0 | 60 | epl | eclipse org legal epl (?:v20|2 0)(?: html)?
boost-1.0 | 60 | license 1 0 | boost org license 1 0(?: txt)?
unlicense | 60 | unlicense org | unlicense org
ofl-1.1 | 60 | licen | scripts sil org ofl(?: licen[cs]e)
cc0-1.0 | 60 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | 60 | creativecommons org | creativecommons org publicdomain mark 1 0
cc-by | 60 | creativecommons org licenses by | creativecommons org licenses by
cc-by-2.0 | 60 | creativecommons org licenses by | creativecommons org licenses by 2 0
cc-by-2.5 | 60 | creativecommons org licenses by | creativecommons org licenses by 2 5
cc-by-3.0 | 60 | creativecommons org licenses by | creativecommons org licenses by 3 0
cc-by-4.0 | 60 | creativecommons org licenses by | creativecommons org licenses by 4 0
cc-by-sa-3.0 | 60 | creativecommons org licenses by sa | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | 60 | creativecommons org licenses by sa | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | 60 | creativecommons org licenses by nc | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 60 | creativecommons org licenses by nd | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 60 | creativecommons org licenses by nc | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 60 | creativecommons org licenses by nc | creativecommons org licenses by nc nd 4 0
gpl | 40 | gnu general public licen | gnu general public licen[cs]e
gpl | 40 | gpl | (?:gnu )?gpl
lgpl | 40 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e
lgpl | 40 | library general public licen | (?:gnu )?library general public licen[cs]e
lgpl | 40 | lgpl | (?:gnu )?lgpl
agpl | 40 | affero general public licen | (?:gnu )?affero general public licen[cs]e
agpl | 40 | agpl | (?:gnu )?agpl
gfdl | 40 | gnu free documentation licen | gnu free documentation licen[cs]e
apache | 40 | apache licen | apache licen[cs]e
apache | 40 | apache software licen | apache software licen[cs]e
mit | 40 | mit licen | (?:the )?mit licen[cs]e
mit | 40 | mit x11 licen | (?:the )?mit x11 licen[cs]e
x11 | 40 | x11 licen | x11 licen[cs]e
isc | 40 | isc licen | isc licen[cs]e
bsd | 40 | bsd | bsd(?: style)? licen[cs]e
zlib | 40 | zlib licen | zlib licen[cs]e
zlib | 40 | libpng licen | zlib libpng licen[cs]e
mpl | 40 | mozilla public licen | mozilla public licen[cs]e
epl | 40 | eclipse public licen | eclipse public licen[cs]e
cddl | 40 | common development and distribution licen | common development and distribution licen[cs]e
eupl | 40 | european union public licen | european union public licen[cs]e
artistic | 40 | artistic licen | artistic licen[cs]e
osl | 40 | open software licen | open software licen[cs]e
afl | 40 | academic free licen | academic free licen[cs]e
boost | 40 | boost software licen | boost software licen[cs]e
psf | 40 | python software foundation licen | python software foundation licen[cs]e
ofl | 40 | open font licen | (?:sil )?open font licen[cs]e
unlicense | 40 | the unlicense | the unlicense
wtfpl | 40 | wtfpl licen | wtfpl licen[cs]e
postgresql | 40 | postgresql licen | postgresql licen[cs]e
php-3.01 | 40 | php licen | (?:the )?php licen[cs]e(?: version 3 01)?
ruby | 40 | ruby licen | (?:the )?ruby licen[cs]e
openssl | 40 | openssl licen | openssl licen[cs]e
ms-pl | 40 | microsoft public licen | microsoft public licen[cs]e
ms-rl | 40 | microsoft reciprocal licen | microsoft reciprocal licen[cs]e
sspl-1.0 | 40 | server side public licen | server side public licen[cs]e
busl-1.1 | 40 | business source licen | business source licen[cs]e
elastic-2.0 | 40 | elastic licen | elastic licen[cs]e
odbl-1.0 | 40 | open database licen | open database licen[cs]e
odc-by-1.0 | 40 | open data commons attribution | open data commons attribution licen[cs]e
openrail | 40 | openrail | (?:creativeml |bigscience )?openrail(?: m| plus plus)? licen[cs]e
cc0 | 40 | cc0 | cc0
cc-by | 40 | cc by | cc by
cc-by-sa | 40 | cc by sa | cc by sa
cc-by-nc | 40 | cc by nc | cc by nc
cc-by-nd | 40 | cc by nd | cc by nd
cc-by-nc-sa | 40 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 40 | cc by nc nd | cc by nc nd
cc-by | 40 | commons attribution | creative commons attribution
cc-by-sa | 40 | commons attribution | creative commons attribution share ?alike
cc-by-nc | 40 | commons attribution | creative commons attribution non ?commercial
cc-by-nd | 40 | commons attribution | creative commons attribution no ?derivatives
cc-by-nc-sa | 40 | commons attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | 40 | commons attribution | creative commons attribution non ?commercial no ?derivatives
public-domain | 40 | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
creative-commons | 20 | creative commons licen | creative commons licen[cs]e
proprietary | 20 | rights reserved | all rights reserved
proprietary | 20 | proprietary and confidential | proprietary and confidential
license-file | 20 | license file | see the license file(?: for details)?
license-file | 20 | the license | see the license for the specific language governing permissions and limitations under the license
unknown-license | 20 | licensed under | licensed under the terms of
"""


class Rule(NamedTuple):
    label: str
    priority: int
    key: str
    pattern: str


RULES = tuple(Rule(label, int(priority), key, pattern) for label, priority, key, pattern in (line.split(" | ", 3) for line in _TEXT.strip().splitlines()))
