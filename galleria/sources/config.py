"""Settings as nested dicts with attribute access, checked overrides and the number forms of result keys."""

from __future__ import annotations

import json
import re
from pathlib import Path

_INT, _HEX = re.compile(r"[+-]?[0-9][0-9_]*"), re.compile(r"[+-]?0x[0-9a-fA-F_]+")
_FLOAT = re.compile(r"[+-]?([0-9][0-9_]*\.[0-9_]*|\.[0-9]+|[0-9][0-9_]*)([eE][+-]?[0-9]+)?")


# Names of folders that hold a part of a split.
SPLIT_NAMES = {"train", "training", "val", "valid", "validation", "test", "testing"}


class Config(dict):
    """A dict whose keys are attributes; nested dicts too."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(f"no setting {name!r}") from None

    def __setattr__(self, name: str, value) -> None:
        self[name] = value

    @classmethod
    def wrap(cls, value):
        if isinstance(value, dict):
            return cls({k: cls.wrap(v) for k, v in value.items()})
        return [cls.wrap(v) for v in value] if isinstance(value, list) else value


def parse_value(text: str):
    """Text as a setting: decimal integers even with leading zeros, 0x, underscores, exponents without a point, lists, words."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        return [parse_value(x) for x in t[1:-1].split(",") if x.strip()]
    low = t.lower()
    if low in ("true", "false", "null", "none", "~", ""):
        return {"true": True, "false": False}.get(low)
    if _HEX.fullmatch(t):
        return int(t.replace("_", ""), 16)
    if _INT.fullmatch(t):
        return int(t.replace("_", ""), 10)
    if _FLOAT.fullmatch(t):
        return float(t.replace("_", ""))
    return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"" else t


def override(cfg: Config, assignment: str) -> None:
    """a.b=v; an unknown key is an error."""
    path, sep, text = assignment.partition("=")
    if not sep:
        raise ValueError(f"{assignment!r} is no key=value")
    node, names = cfg, path.strip().split(".")
    for k, name in enumerate(names):
        if not isinstance(node, dict) or name not in node:
            raise KeyError(f"unknown setting {'.'.join(names[: k + 1])!r}")
        if k == len(names) - 1:
            node[name] = parse_value(text)
        node = node[name]


def parse_yaml(text: str):
    """A YAML document; plain scalars are read as parse_value reads them, quoted ones and keys stay text."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need PyYAML; JSON settings don't") from e

    def value(node):
        if isinstance(node, yaml.MappingNode):
            return {k.value: value(v) for k, v in node.value}
        if isinstance(node, yaml.SequenceNode):
            return [value(x) for x in node.value]
        return parse_value(node.value) if node.style is None else node.value

    root = yaml.compose(text, Loader=yaml.SafeLoader)
    return None if root is None else value(root)


def load_config(path: str, overrides: list[str] | None = None, roots: tuple[str, ...] = ()) -> Config:
    """Settings of a YAML or JSON file with overrides. Relative entries of `paths` are taken from the file's folder; those named
    in `roots` go down through folders that hold one folder only, as released data sets have."""
    at = Path(path)
    if not at.exists():
        raise FileNotFoundError(f"no settings at {path}")
    text = at.read_text(encoding="utf-8")
    cfg = Config.wrap((json.loads(text) if at.suffix == ".json" else parse_yaml(text)) or {})
    for assignment in overrides or []:
        override(cfg, assignment)
    for name, value in list((cfg.get("paths") or {}).items()):
        if value is not None:
            full = (at.parent / str(value)).resolve()
            cfg["paths"][name] = str(single_folder(str(full), SPLIT_NAMES) if name in roots and full.is_dir() else full)
    return cfg


def dump_config(cfg: dict, path: str) -> None:
    """The settings of a run as JSON, in one step."""
    from .tables import write_text

    write_text(path, json.dumps(cfg, indent=2, ensure_ascii=False))


def single_folder(root: str, split_names: set[str]) -> Path:
    """Down through folders that hold one folder only, unless it is a split folder."""
    at = Path(root)
    while True:
        inner = [p for p in at.iterdir() if not p.name.startswith((".", "__MACOSX"))]
        if len(inner) != 1 or not inner[0].is_dir() or inner[0].name.lower() in split_names:
            return at
        if not any(p.is_dir() for p in inner[0].iterdir()):
            return at
        at = inner[0]
