"""Settings of the index and align commands, and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_K = 63
DEFAULT_K = 31


@dataclass
class Settings:
    """k must be odd, above 8 and at most MAX_K; ``index`` keeps every k-mer, other commands those seen twice."""

    command: str = "align"
    k: int = DEFAULT_K
    inputs: list[tuple[str, str | None]] = field(default_factory=list)
    work_path: str = "."
    max_visits: int = 1000
    search_depth: int = 5000
    branch_and_bound: bool = True
    markov_filter: bool = True
    mem_seeds: bool = True
    double_stranded: bool = True
    abundance_min: int | None = None

    def __post_init__(self):
        if self.command not in ("assemble", "index", "align"):
            raise ValueError(f"unknown command: {self.command}")
        if not 8 < self.k <= MAX_K or self.k % 2 == 0:
            raise ValueError(f"k must be odd, above 8 and at most {MAX_K}: {self.k}")
        if self.abundance_min is None:
            self.abundance_min = 1 if self.command == "index" else 2

    @property
    def last_stage(self) -> int:
        return {"index": 2, "align": 3, "assemble": 3}[self.command]
