"""Settings from ``.codeloom.toml``; anything missing or unreadable falls back to the defaults."""

import dataclasses
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from codeloom import constants as C

FILE_NAME = ".codeloom.toml"


@dataclass
class Repository:
    respect_gitignore: bool = True
    max_file_bytes: int = C.MAX_FILE_BYTES
    include: list = field(default_factory=lambda: list(C.DEFAULT_INCLUDES))
    exclude: list = field(default_factory=lambda: list(C.DEFAULT_EXCLUDES))


@dataclass
class Index:
    parse_workers: int = 4


@dataclass
class Watch:
    enabled: bool = True
    debounce_ms: int = 300


@dataclass
class Search:
    semantic: bool = False
    default_limit: int = C.SEARCH_LIMIT


@dataclass
class Output:
    max_chars: int = C.BUDGET_CHARS
    max_usages: int = 20


@dataclass
class Config:
    repository: Repository = field(default_factory=Repository)
    index: Index = field(default_factory=Index)
    watch: Watch = field(default_factory=Watch)
    search: Search = field(default_factory=Search)
    output: Output = field(default_factory=Output)

    @classmethod
    def from_dict(cls, data: dict) -> "Config":
        parts = {}
        for part in dataclasses.fields(cls):
            kind = part.default_factory
            known = {f.name for f in dataclasses.fields(kind)}
            parts[part.name] = kind(**{k: v for k, v in data.get(part.name, {}).items() if k in known})
        return cls(**parts)

    @classmethod
    def load(cls, root) -> "Config":
        try:
            return cls.from_dict(tomllib.loads((Path(root) / FILE_NAME).read_text(encoding="utf-8")))
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()

    def to_toml(self) -> str:
        lines = []
        for part in dataclasses.fields(self):
            lines.append(f"[{part.name}]")
            for name, value in dataclasses.asdict(getattr(self, part.name)).items():
                shown = str(value).lower() if isinstance(value, bool) else str(value).replace("'", '"')
                lines.append(f"{name} = {shown}")
            lines.append("")
        return "\n".join(lines)


def gitignore_lines(root) -> list[str]:
    """Patterns of the root ignore file."""
    try:
        lines = (Path(root) / ".gitignore").read_text(encoding="utf-8", errors="ignore").splitlines()
    except OSError:
        return []
    return [s for s in (line.strip() for line in lines) if s and not s.startswith("#")]
