"""Frozen settings of each stage, with the defaults of its command line."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Linking:
    top_k: int = 1
    threshold: float = 0.35
    max_chars: int | None = None
    dims: int = 256
    encoder: str = "trigrams"
    use_cells: bool = False
    cells_above: int = 50_000


@dataclass(frozen=True)
class Support:
    min_rows: int = 10


@dataclass(frozen=True)
class Cooccurrence:
    statuses: tuple[str, ...] = ()
    present_only: bool = False
    delimiter: str = "||"
    min_patients: int = 1
    min_cooccur: int = 1
    cap: int = 0
    shift_k: float = 1.0

    @staticmethod
    def parse_statuses(text: str | None) -> tuple[str, ...]:
        """None, blank and ALL mean no filter; otherwise upper-cased names."""
        names = tuple(sorted({x.strip().upper() for x in (text or "").split(",") if x.strip()}))
        return () if not names or "ALL" in names else names

    def wanted(self) -> tuple[str, ...]:
        return ("PRESENT",) if self.present_only else self.statuses


@dataclass(frozen=True)
class Spectral:
    k: int = 128
    method: str = "sqrt_evals"
    threshold: float | None = None
    drop_diagonal: bool = True
    symmetrize: bool = True
    driver_limit: int = 3000
    which: str = "LA"
    tol: float = 1e-6
    steps: int = 60
    ncv: int | None = None
    seed: int = 0
    save_matrix: bool = False


@dataclass(frozen=True)
class TopPairs:
    k_search: int = 2000
    top_pp: int = 100
    top_other: int = 10
    pp_label: str = "PRESENT"
    default_status: str = "PRESENT"
    undirected: bool = False


@dataclass(frozen=True)
class Scoring:
    model: str = "offline-rules"
    temperature: float = 0.0
    concurrency: int = 10
    max_retries: int = 5
    first_wait: float = 1.0
    longest_wait: float = 20.0


@dataclass(frozen=True)
class Labels:
    mode: str = "tristate"
    low: float = 50.0
    high: float = 85.0
    threshold: float | None = None
    null_scores: str = "uncertain"


@dataclass(frozen=True)
class Pipeline:
    key_delimiter: str = "-"
    linking: Linking = Linking()
    support: Support = Support()
    cooccurrence: Cooccurrence = Cooccurrence()
    spectral: Spectral = Spectral()
    pairs: TopPairs = TopPairs(top_pp=500, top_other=50)
    scoring: Scoring = Scoring()
    labels: Labels = Labels(low=20.0, high=80.0)
    strict: bool = False
    extra: dict = field(default_factory=dict)
