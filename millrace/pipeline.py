"""A run of named stages with a state file: what is done is skipped, a failure is recorded and stops the run."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable


class Pipeline:
    """stages: name -> function without arguments. The state file keeps status, seconds and error of each, and is replaced whole."""

    def __init__(self, stages: dict[str, Callable[[], object]], state_path: str, always: tuple[str, ...] = ()):
        self.stages, self.path, self.always = stages, state_path, always
        self.state: dict[str, dict] = {}
        if os.path.exists(state_path):
            with open(state_path, encoding="utf-8") as f:
                self.state = json.load(f)

    def _keep(self, name: str, **entry: object) -> None:
        self.state[name] = entry
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(self.state, f, indent=1)
        os.replace(self.path + ".new", self.path)

    def run(self, only: tuple[str, ...] = ()) -> bool:
        """True if every stage that was due has ended well."""
        for name, stage in self.stages.items():
            done = self.state.get(name, {}).get("status") == "done"
            if only and name not in only or done and name not in self.always:
                continue
            began = time.time()
            try:
                stage()
            except Exception as e:  # the run's state must say what happened, whatever it was
                self._keep(name, status="failed", seconds=round(time.time() - began, 3), error=f"{type(e).__name__}: {e}"[:2000])
                return False
            self._keep(name, status="done", seconds=round(time.time() - began, 3), error=None)
        return True
