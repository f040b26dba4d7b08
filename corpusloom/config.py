"""Settings, index identity and the defaults that decide results."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

# Default globs.
INCLUDE_GLOBS = ["apps/**", "services/**", "libs/**", "docs/**", "deploy/**", "scripts/**", "tools/**", "agent_context/**", "AGENTS.md", "CLAUDE.md", "STRUCTURE.md"]
EXCLUDE_GLOBS = [
    ".git/**", ".venv/**", "venv/**", "**/__pycache__/**", "node_modules/**", "artifacts/**", "tmp/**", "temp/**",
    "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.webp", "**/*.ico", "**/*.svg",
    "**/*.zip", "**/*.gz", "**/*.tar", "**/*.7z", "**/*.pdf", "**/*.db", "**/*.sqlite",
    "**/.env*", "**/*.pem", "**/*.key", "**/*.crt", "**/*.pfx", "**/*.kdbx",
]
# Ours: also keeps nested copies of excluded folders and a root .env out.
SAFE_EXCLUDE_GLOBS = ["**/node_modules/**", "**/.venv/**", "**/venv/**", "**/.git/**", ".env*", "*.pem", "*.key"]


def slug(value: str) -> str:
    """The last path part in lower case with every other run of characters as one underscore; `model` if empty."""
    last = value.strip().lower().rsplit("/", 1)[-1]
    return re.sub(r"[^a-z0-9]+", "_", last).strip("_") or "model"


def default_repo_key(root: str | Path) -> str:
    root = Path(root).resolve()
    return f"{slug(root.name)}_{hashlib.sha1(str(root).encode()).hexdigest()[:8]}"


@dataclass(frozen=True)
class Settings:
    repo_root: str = "."
    repo_key: str | None = None
    prefix: str = "corpusloom"
    profile_name: str = "cpu_e5"
    embedding_backend: str = "hashing"
    embedding_model: str = "intfloat/multilingual-e5-small"
    embedding_url: str | None = None
    query_template: str = "query: {query}"
    document_prefix: str = "passage: "
    query_prompt_name: str | None = None
    document_prompt_name: str | None = None
    index_schema_version: int = 1
    include_globs: list[str] = field(default_factory=lambda: list(INCLUDE_GLOBS))
    exclude_globs: list[str] = field(default_factory=lambda: list(EXCLUDE_GLOBS))
    safe_excludes: bool = True
    watch_debounce_sec: int = 3
    auto_index_on_start: bool = True
    embed_batch_docs: int = 24
    embed_batch_chars: int = 12_000
    max_chunk_chars: int = 800
    window_lines: int = 80
    window_chars: int = 2400
    section_chars: int = 2600
    legacy_lines: bool = False
    snippet_chars: int = 280
    dense_weight: float = 0.7
    lexical_weight: float = 0.3
    overfetch: int = 6
    overfetch_floor: int = 30
    hybrid_overfetch: int = 5
    hybrid_floor: int = 25

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "CORPUSLOOM_", **given) -> Settings:
        """From environment names such as CORPUSLOOM_REPO_ROOT; lists are split at commas, `\\n` becomes a line break in three text fields."""
        env = os.environ if env is None else env
        found: dict = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            default = getattr(cls(), f.name)
            if isinstance(default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, int):
                found[f.name] = int(raw)
            elif isinstance(default, float):
                found[f.name] = float(raw)
            elif isinstance(default, list):
                found[f.name] = [x.strip() for x in raw.split(",") if x.strip()]
            elif f.name in ("query_template", "document_prefix", "profile_name"):
                found[f.name] = raw.replace("\\n", "\n")
            else:
                found[f.name] = raw
        return cls(**(found | given))

    @property
    def key(self) -> str:
        return slug(self.repo_key) if self.repo_key else default_repo_key(self.repo_root)

    @property
    def excludes(self) -> list[str]:
        return self.exclude_globs + (SAFE_EXCLUDE_GLOBS if self.safe_excludes else [])

    def table_name(self, scope: str) -> str:
        """One name for each repository, profile, model, scope and schema version: incompatible vectors never share a table."""
        return f"{self.prefix}_{self.key}_{slug(self.profile_name)}_{slug(self.embedding_model)}_{scope}_v{self.index_schema_version}"

    def index_name(self) -> str:
        return f"{self.prefix}_{self.key}_{slug(self.profile_name)}_{slug(self.embedding_model)}_v{self.index_schema_version}"

    def index_profile(self) -> str:
        name = self.profile_name.strip()
        prompts = (self.query_prompt_name, self.document_prompt_name) if self.embedding_backend == "http" else ()
        return name or ("formatted" if self.query_template != "{query}" or self.document_prefix or any(prompts) else "default")
