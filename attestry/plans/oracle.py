"""Reads the DuckDB twins: named SQL pieces, each listing the views it uses."""

from __future__ import annotations

from pathlib import Path

ROOT = Path(__file__).resolve().parents[2] / "oracle"


def _pieces(path: Path) -> dict[str, tuple[list[str], str]]:
    out: dict[str, tuple[list[str], str]] = {}
    name, uses, body = None, [], []
    for line in [*path.read_text().splitlines(), "-- name: "]:
        if line.startswith("-- name:"):
            if name:
                out[name] = (uses, "\n".join(body).strip())
            name, uses, body = line.split(":", 1)[1].strip(), [], []
        elif line.startswith("-- uses:"):
            uses = [u.strip() for u in line.split(":", 1)[1].split(",")]
        elif not line.startswith("--"):
            body.append(line)
    return out


def load() -> dict[str, str]:
    """key -> one SQL text with its views as common table expressions."""
    views = _pieces(ROOT / "views.sql")
    out = {}
    for path in sorted(ROOT.glob("*.sql")):
        if path.name == "views.sql":
            continue
        for key, (uses, body) in _pieces(path).items():
            order: list[str] = []

            def need(view: str) -> None:
                if view in order:
                    return
                for inner in views[view][0]:
                    need(inner)
                order.append(view)

            for view in uses:
                need(view)
            head = ",\n".join(f"{v} AS ({views[v][1]})" for v in order)
            out[key] = f"WITH RECURSIVE {head}\n{body}" if head else body
    return out
