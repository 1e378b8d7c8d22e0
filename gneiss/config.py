"""Settings of the engine: one frozen dataclass, with values from the environment where they are good."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    max_total_bytes: int = 20 << 20
    max_file_bytes: int = 1 << 20
    max_chunk_bytes: int = 8 << 10
    max_chunk_lines: int = 200
    search_file_bytes: int = 1_000_000
    mention_file_bytes: int = 300_000
    js_file_bytes: int = 400_000
    script_file_bytes: int = 500_000
    preferred_exts: tuple[str, ...] = (".go", ".js", ".json", ".jsx", ".md", ".php", ".ts", ".tsx", ".yaml", ".yml")
    allow_globs: tuple[str, ...] = (".github/workflows/*", "Dockerfile", "Makefile", "README*", "Taskfile.yaml", "Taskfile.yml", "go.mod", "go.sum")
    deny_globs: tuple[str, ...] = ("*.bin", "*.crt", "*.db", "*.der", "*.exe", "*.key", "*.p12", "*.pem", "*.pfx", "*.ppk", "*.sqlite", "id_ed25519", "id_rsa")
    ignore_dirs: tuple[str, ...] = ()
    ignore_globs: tuple[str, ...] = ()
    flush_ms: int = 500
    poll_seconds: int = 10
    git_poll_seconds: int = 2

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "GNEISS_") -> Config:
        """Whole numbers above 0 from the environment, e.g. GNEISS_MAX_TOTAL_BYTES; anything else keeps the default."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper(), "").strip()
            if f.type == "int" and text.isdigit() and int(text) > 0:
                found[f.name] = int(text)
        return replace(cls(), **found)
