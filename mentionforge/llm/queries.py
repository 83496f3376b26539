"""The queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from .archives import OP7_SQL, op7_warc
from .licenses import OP9_SQL, op9_licenses
from .mixing import op10_mixing
from .near_copies import OP6_SQL, op6_near_copies
from .near_vectors import OP3_SQL, op3_near_vectors
from .neighbours import op4_neighbours
from .piece_codec import op5_piece_codec
from .quality import op8_quality
from .repeats import OP1_SQL, op1_repeats
from .secrets import OP2_SQL, op2_secrets

QUERIES = {f.__name__: f for f in (op1_repeats, op2_secrets, op3_near_vectors, op4_neighbours, op5_piece_codec, op6_near_copies, op7_warc, op8_quality, op9_licenses, op10_mixing)}
ORACLES = {"op1_repeats": OP1_SQL, "op2_secrets": OP2_SQL, "op3_near_vectors": OP3_SQL, "op6_near_copies": OP6_SQL, "op7_warc": OP7_SQL, "op9_licenses": OP9_SQL}
