"""Wall-clock and CPU time of phases, as a list or a table."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager


class Timing:
    """``with t.phase("scan"): ...`` for each phase; phases may be nested, and one run twice adds up."""

    def __init__(self) -> None:
        self.rows: dict[str, list[float]] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began, cpu = time.perf_counter(), os.times()
        try:
            yield
        finally:
            now = os.times()
            row = self.rows.setdefault(name, [0.0, 0.0, 0.0])
            for i, x in enumerate((now.user + now.children_user - cpu.user - cpu.children_user, now.system + now.children_system - cpu.system - cpu.children_system, time.perf_counter() - began)):
                row[i] += x

    def report(self, table: bool = False) -> str:
        """Seconds of user, system and elapsed time; the table has the share of CPU, too."""
        if not table:
            return "\n".join(f"- {k}: user {u:.3f}s, system {s:.3f}s, elapsed {e:.3f}s" for k, (u, s, e) in self.rows.items())
        head = f"{'period':<24} {'user[s]':>9} {'system[s]':>9} {'elapsed[s]':>10} {'%CPU':>6}"
        return "\n".join([head, *(f"{k:<24} {u:9.3f} {s:9.3f} {e:10.3f} {100 * (u + s) / e if e else 0:6.1f}" for k, (u, s, e) in self.rows.items())])
