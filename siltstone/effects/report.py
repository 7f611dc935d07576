"""Results as text."""

from __future__ import annotations


def human(n: int) -> str:
    for power, unit in ((30, "GiB"), (20, "MiB"), (10, "KiB")):
        if n >= 1 << power:
            return f"{n / (1 << power):.1f} {unit}"
    return f"{n} B"


def sync_text(r: dict) -> str:
    lines = [
        f"copied {r['copied']}, skipped {r['skipped']}, failed {r['failed']}",
        f"{human(r['bytes'])} copied, {human(r['dedup_saved'])} saved by stored content",
    ]
    if r.get("cancelled"):
        lines.append(f"stopped with {r['cancelled']} files not begun; the next run goes on")
    lines += [f"failed: {p}: {e}" for p, e in r.get("errors", [])]
    lines += [f"in use: {p}" for p in r.get("locked", [])]
    return "\n".join(lines)
