"""Engine options: presets, and files in YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from lumenfold.functions.scalars import DEFAULT_WEIGHTS
from lumenfold.schema import ENGINE_FORMATS


@dataclass
class EngineConfig:
    """Options of the engine. ``workers`` is kept for configuration files: how much runs at once is a matter of Spark's own settings."""

    index_path: str = "index"
    workers: int = 4
    log_level: str = "info"
    hashes: dict[str, bool] = field(default_factory=lambda: {"a_hash": True, "p_hash": True, "d_hash": True, "w_hash": False})
    hash_size: int = 8
    hash_variant: str = "engine"
    quality: dict = field(default_factory=lambda: {"sharpness_threshold": 0.1, "noise_threshold": 0.3, "min_exposure": 0.1, "max_exposure": 0.9, "min_contrast": 0.2})
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    min_similarity: float = 0.8
    formats: tuple[str, ...] = ENGINE_FORMATS
    exclude_dirs: tuple[str, ...] = ()
    max_file_size_mb: int = 0
    compat_exif: bool = False
    extra: dict = field(default_factory=dict)

    def hash_names(self) -> list[str]:
        return [n for n, on in self.hashes.items() if on]

    def file_filter(self):
        from lumenfold.sources.files import FileFilter

        return FileFilter(tuple(self.formats), (), 0, self.max_file_size_mb << 20, tuple(self.exclude_dirs))

    @classmethod
    def default(cls) -> EngineConfig:
        return cls()

    @classmethod
    def high_performance(cls) -> EngineConfig:
        c = cls(workers=8)
        return replace(c, hashes=c.hashes | {"w_hash": True})

    @classmethod
    def accuracy(cls) -> EngineConfig:
        return cls(workers=2, hash_size=16)

    @classmethod
    def fast(cls) -> EngineConfig:
        c = cls(workers=1)
        return replace(c, hashes=c.hashes | {"p_hash": False, "w_hash": False})


_HASH_KEYS = {"a_hash": "compute_ahash", "p_hash": "compute_phash", "d_hash": "compute_dhash", "w_hash": "compute_whash"}
_WEIGHT_KEYS = {"a_hash": "ahash_weight", "p_hash": "phash_weight", "d_hash": "dhash_weight", "w_hash": "whash_weight"}


def from_dict(d: dict) -> EngineConfig:
    """Sections engine, hashing, quality, similarity and scanner; missing keys keep their defaults."""
    base = EngineConfig()
    engine, hashing, quality, sim, scan = (d.get(k) or {} for k in ("engine", "hashing", "quality", "similarity", "scanner"))
    return replace(
        base,
        index_path=engine.get("index_path", base.index_path),
        workers=int(engine.get("num_workers", base.workers)),
        log_level=engine.get("log_level", base.log_level),
        hashes={h: bool(hashing.get(k, base.hashes[h])) for h, k in _HASH_KEYS.items()},
        hash_size=int(hashing.get("hash_size", base.hash_size)),
        quality=base.quality | {k: v for k, v in quality.items()},
        weights={h: float(sim.get(k, base.weights[h])) for h, k in _WEIGHT_KEYS.items()},
        min_similarity=float(sim.get("min_similarity", base.min_similarity)),
        formats=tuple(scan.get("supported_formats", base.formats)),
        exclude_dirs=tuple(scan.get("exclude_dirs", base.exclude_dirs)),
        max_file_size_mb=int(scan.get("max_file_size_mb", base.max_file_size_mb)),
        extra={k: v for k, v in d.items() if k not in ("engine", "hashing", "quality", "similarity", "scanner")},
    )


def to_dict(c: EngineConfig) -> dict:
    return {
        "engine": {"index_path": c.index_path, "num_workers": c.workers, "log_level": c.log_level},
        "hashing": {k: c.hashes[h] for h, k in _HASH_KEYS.items()} | {"hash_size": c.hash_size},
        "quality": dict(c.quality),
        "similarity": {"min_similarity": c.min_similarity} | {k: c.weights[h] for h, k in _WEIGHT_KEYS.items()},
        "scanner": {"supported_formats": list(c.formats), "exclude_dirs": list(c.exclude_dirs), "max_file_size_mb": c.max_file_size_mb},
        **c.extra,
    }


def load(path: str | Path) -> EngineConfig:
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text()) or {})


def save(c: EngineConfig, path: str | Path) -> None:
    import yaml

    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(yaml.safe_dump(to_dict(c), sort_keys=False))


def exists(path: str | Path) -> bool:
    return Path(path).is_file()


def default_path() -> Path:
    return Path.home() / ".lumenfold" / "config.yaml"


def as_dict(c: EngineConfig) -> dict:
    return asdict(c)
