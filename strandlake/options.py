"""Options of search and clustering, their ranges, and the speed macro."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Nine sort keys, by code.
SORT_KEYS = ("tm_greater", "tm_refn", "tm_query", "tm_harmonic", "rmsd", "tm2_greater", "tm2_refn", "tm2_query", "tm2_harmonic")
DEPTHS = ("deep", "high", "medium", "shallow")

#: --speed as (depth, trigger, changes beyond those two) (fixed values).
SPEEDS = (
    ("deep", 0, {"nbranches": 16, "search_by_ss": True}),
    ("deep", 0, {}),
    ("deep", 20, {}),
    ("deep", 50, {}),
    ("high", 0, {}),
    ("high", 20, {}),
    ("high", 50, {}),
    ("medium", 0, {}),
    ("medium", 20, {}),
    ("medium", 50, {}),
    ("shallow", 0, {"refinement": "coarse", "convergence": 2}),
    ("shallow", 20, {"refinement": "coarse", "convergence": 2}),
    ("shallow", 50, {"refinement": "coarse", "convergence": 2}),
    (None, None, {"detailed": False, "refinement": "coarse", "convergence": 2}),
)


@dataclass(frozen=True)
class SearchOptions:
    """What a search computes and reports."""

    score_threshold: float = 0.5
    sort: str = "tm_greater"
    hits: int = 2000
    alignments: int = 2000
    wrap: int = 80
    no_deletions: bool = False
    referenced: bool = False
    second_tm: bool = False
    pre_similarity: float = 0.0
    pre_score: float = 0.4
    symmetric: bool = False
    refinement: str = "one"
    depth: str = "medium"
    trigger: int = 50
    nbranches: int = 5
    search_by_ss: bool = False
    detailed: bool = True
    convergence: int = 18
    gap_cost: float = 0.6
    seed_rule: int = 64
    window: int = 256
    min_length: int = 20
    max_length: int = 4000

    def __post_init__(self):
        checks = {
            "score_threshold": 0 <= self.score_threshold < 1,
            "sort": self.sort in SORT_KEYS,
            "hits": 0 < self.hits < 1_000_000,
            "alignments": 0 < self.alignments < 1_000_000,
            "wrap": 40 <= self.wrap < 99_999_999,
            "pre_similarity": self.pre_similarity >= 0,
            "pre_score": 0 <= self.pre_score < 1,
            "refinement": self.refinement in ("coarse", "one", "few", "full"),
            "depth": self.depth in DEPTHS,
            "trigger": 0 <= self.trigger <= 100,
            "nbranches": 1 <= self.nbranches <= 16,
            "convergence": 1 <= self.convergence <= 30,
            "seed_rule": self.seed_rule in (0, 64, 128),
            "window": self.window in (256, 512),
            "min_length": 3 <= self.min_length <= 32_767,
            "max_length": 100 <= self.max_length <= 65_535,
        }
        bad = [k for k, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
        if self.sort.startswith("tm2") and not self.second_tm:
            raise ValueError("sorting by the second TM-score needs second_tm")

    def at_speed(self, speed: int) -> SearchOptions:
        """The options that a speed level stands for."""
        if not 0 <= speed < len(SPEEDS):
            raise ValueError("speed is 0 to 13")
        depth, trigger, more = SPEEDS[speed]
        return replace(self, depth=depth or self.depth, trigger=self.trigger if trigger is None else trigger, **more)


@dataclass(frozen=True)
class ClusterOptions:
    """How all-against-all results become clusters."""

    threshold: float = 0.5
    coverage: float = 0.7
    one_sided: bool = False
    linkage: str = "complete"
    measure: str = "tm_greater"
    sequences: bool = False

    def __post_init__(self):
        if self.measure not in SORT_KEYS[:5]:
            raise ValueError("clustering measures TM-score or RMSD")
        if not 0 <= self.threshold < 100 or (self.measure != "rmsd" and self.threshold > 1):
            raise ValueError("the threshold is at most 1 unless it is an RMSD")
        if not 0 < self.coverage <= 1:
            raise ValueError("coverage is above 0 and at most 1")
        if self.linkage not in ("single", "complete"):
            raise ValueError("linkage is single or complete")

    @property
    def cut(self) -> float:
        """The distance at which the tree is cut."""
        return self.threshold if self.measure == "rmsd" else max(0.0, 1 - self.threshold)


@dataclass(frozen=True)
class ReadOptions:
    """How structure files are read."""

    aatom: str = " CA "
    natom: str = " C3'"
    hetatm: bool = False
    mol: str | None = None
    ter: int = 3
    split: int = 0
    infmt: str | None = None
    suffixes: tuple[str, ...] = ()

    def __post_init__(self):
        if self.ter not in (0, 1, 2, 3) or self.split not in (0, 1, 2):
            raise ValueError("ter is 0 to 3 and split 0 to 2")
        if self.split == 1 and self.ter not in (0,) or self.split == 2 and self.ter not in (0, 1):
            raise ValueError("split by model needs ter 0; split by chain needs ter 0 or 1")
        if self.infmt not in (None, "pdb", "cif"):
            raise ValueError("infmt is pdb or cif")
        if self.mol not in (None, "Protein", "NA"):
            raise ValueError("mol is Protein or NA")
