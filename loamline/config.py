"""Parameters of a scan, validated when they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

DAY = 86_400


@dataclass(frozen=True)
class CouplingConfig:
    """Temporal coupling: buckets in days, times in seconds."""

    bucket_days: int = 91
    min_bursts: int = 10
    min_ratio: float = 0.8
    gap: int = 3600
    overlap: int = 3600
    min_distance: int = 3
    max_common_roots: int | None = None

    def __post_init__(self) -> None:
        if self.bucket_days < 1 or self.gap < 0 or self.overlap < 0:
            raise ValueError("a bucket takes at least one day, and times can't be negative")

    @classmethod
    def from_minutes(cls, gap: int, overlap: int, **rest) -> CouplingConfig:
        return cls(gap=gap * 60, overlap=overlap * 60, **rest)

    @property
    def bucket_size(self) -> int:
        return self.bucket_days * DAY

    def metadata(self) -> dict:
        """The parameters in the document's names."""
        names = {"min_ratio": "min_coupling_ratio", "gap": "min_activity_gap", "overlap": "coupling_time_distance"}
        return {names.get(k, k): v for k, v in asdict(self).items()}


@dataclass(frozen=True)
class ScanConfig:
    """What a scan computes; ``calculators`` are names of the registry."""

    root: str
    name: str | None = None
    id: str | None = None
    git: bool = True
    git_details: bool = True
    file_stats: bool = True
    follow_symlinks: bool = False
    years: int = 3
    include_merges: bool = True
    nearest_repository: bool = False
    unknown_as_text: bool = True
    coupling: CouplingConfig | None = None
    calculators: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.coupling and not self.git:
            raise ValueError("coupling needs the git history")
        if self.git_details and not self.git:
            raise ValueError("git details need the git history")
        if not self.calculators:
            object.__setattr__(self, "calculators", ("loc", "indentation", *["git"] * self.git, *["file_stats"] * self.file_stats))
        if ("git" in self.calculators) != self.git:
            raise ValueError("the git flag and the list of calculators contradict each other")
