"""Settings of a reconstruction: TOML, then section.key=value overrides, then environment variables; unknown keys are refused."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

#: (section, key) of each field.
_PLACES = {
    "n_images": ("runtime", "n_images"), "workers": ("runtime", "workers"), "out": ("data", "out"), "verbose": ("debug", "verbose"),
    "det_shape": ("detector", "shape"), "n_clipping": ("runtime", "n_clipping"), "n_binning": ("runtime", "n_binning"),
    "oversampling": ("algorithm", "oversampling"), "n_generations": ("algorithm", "n_generations"), "n_orientations": ("algorithm", "n_orientations"),
    "n_phase_loops": ("algorithm", "n_phase_loops"), "n_er": ("algorithm", "n_er"), "n_hio": ("algorithm", "n_hio"), "beta": ("algorithm", "beta"),
    "shrinkwrap": ("algorithm", "shrinkwrap"), "cutoff": ("algorithm", "cutoff"), "solve_steps": ("algorithm", "solve_steps"), "members": ("algorithm", "members"),
    "seed": ("algorithm", "seed"), "side": ("algorithm", "side"), "check_convergence": ("fsc", "check_convergence"), "min_cc": ("fsc", "min_cc"), "min_change_cc": ("fsc", "min_change_cc"),
    "absolute_change": ("fsc", "absolute_change"), "match_scale": ("algorithm", "match_scale"), "match_batch": ("algorithm", "match_batch"),
    "density_cap": ("algorithm", "density_cap"),
}


@dataclass(frozen=True)
class Settings:
    #: Images to use; 0 takes all.
    n_images: int = 0
    workers: int = 4
    out: str = ""
    verbose: bool = False
    det_shape: tuple[int, ...] = (1, 8, 8)
    n_clipping: int = 0
    n_binning: int = 0
    oversampling: float = 1.0
    n_generations: int = 3
    n_orientations: int = 200
    n_phase_loops: int = 2
    n_er: int = 10
    n_hio: int = 5
    beta: float = 0.3
    shrinkwrap: str = "std"
    cutoff: float = 0.05
    solve_steps: int = 100
    members: int = 4
    seed: int = 0
    #: Side of the volumes; 0 takes it from the oversampling.
    side: int = 0
    check_convergence: bool = False
    min_cc: float = 0.8
    min_change_cc: float = 0.05
    absolute_change: bool = False
    #: Slices are scaled together (global), by batches of orientations (batch), or not (none).
    match_scale: str = "global"
    match_batch: int = 1000
    #: Largest density that phasing lets stand; 0 is none.
    density_cap: float = 0.0

    @property
    def quarter(self) -> int:
        return int(20 * self.oversampling)

    @property
    def m(self) -> int:
        return self.side or 4 * self.quarter + 1

    @property
    def m_upsampled(self) -> int:
        return 2 * self.m

    @property
    def reduced_det_shape(self) -> tuple[int, int, int]:
        f = 2 ** (self.n_clipping + self.n_binning)
        return self.det_shape[0], self.det_shape[1] // f, self.det_shape[2] // f

    def as_toml(self) -> str:
        sections: dict[str, list[str]] = {}
        for f in fields(self):
            section, key = _PLACES[f.name]
            v = getattr(self, f.name)
            text = str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(list(v)) if isinstance(v, tuple) else str(v)
            sections.setdefault(section, []).append(f"{key} = {text}")
        return "\n\n".join("\n".join([f"[{s}]", *lines]) for s, lines in sections.items()) + "\n"


def _parsed(value: Any, kind: Any) -> Any:
    if kind is bool:
        return value if isinstance(value, bool) else str(value).strip().lower() in {"1", "on", "true"}
    if kind is tuple:
        items = value if isinstance(value, list) else [x for x in str(value).strip("[]() ").split(",") if x.strip()]
        return tuple(int(x) for x in items)
    return os.path.expandvars(str(value)) if kind is str else kind(value)


def load(path: str | Path | None = None, overrides: list[str] | None = None, env: dict[str, str] | None = None) -> Settings:
    """env: ORBWEAVE_SECTION_KEY wins over an override, which wins over the file."""
    where = {place: name for name, place in _PLACES.items()}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    got: dict[str, Any] = {}

    def put(section: str, key: str, value: Any) -> None:
        if (section, key) not in where:
            raise ValueError(f"unknown setting {section}.{key}")
        name = where[section, key]
        got[name] = _parsed(value, kinds[name])

    if path:
        for section, keys in tomllib.loads(Path(path).read_text()).items():
            for key, value in keys.items():
                put(section, key, value)
    for o in overrides or []:
        left, eq, value = o.partition("=")
        section, dot, key = left.partition(".")
        if not eq or not dot:
            raise ValueError(f"an override is section.key=value, not {o!r}")
        put(section, key, value)
    env = dict(os.environ) if env is None else env
    for (section, key) in where:
        if (name := f"ORBWEAVE_{section}_{key}".upper()) in env:
            put(section, key, env[name])
    return Settings(**got)
