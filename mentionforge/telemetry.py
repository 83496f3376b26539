"""Samples of this machine's load, taken beside a run and summed up by labels.telemetry."""

from __future__ import annotations

import csv
import os
import resource
import threading
import time


class Sampler:
    """Appends (time, util, mem_used, power, temp) to a CSV file every `period` seconds while it is entered.

    util is the load per core in percent and mem_used the largest resident size in MB; power and temp stay empty where
    no reader is given (read: a function of no arguments that gives both).
    """

    def __init__(self, path: str, period: float = 1.0, read=lambda: (None, None)):
        self.path, self.period, self.read, self._end = path, period, read, threading.Event()

    def sample(self) -> list:
        power, temp = self.read()
        return [round(time.time(), 3), round(100 * os.getloadavg()[0] / (os.cpu_count() or 1), 3), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, power, temp]

    def _run(self) -> None:
        with open(self.path, "a", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            if not f.tell():
                out.writerow(["time", "util", "mem_used", "power", "temp"])
            while True:
                out.writerow(self.sample())
                f.flush()
                if self._end.wait(self.period):
                    return

    def __enter__(self):
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_):
        self._end.set()
        self._thread.join()
