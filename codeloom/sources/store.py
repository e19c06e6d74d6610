"""Generations of an index on disk: publishing, pointing to and keeping them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from codeloom.plans.snapshot import Snapshot

#: Newest generations that are kept.
KEPT = 5


class GenerationStore:
    """A folder with one sub-folder for each generation and a small file of references to them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of the reference files, ascending."""
        root = self._path(self.root)
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[5:-5]) for n in names if n.startswith("refs-") and n.endswith(".json") and n[5:-5].isdigit())

    def _read(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"order": [], "refs": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/refs-{numbers[-1]}.json").collect()))

    def publish(self, snapshot: Snapshot, names: list[str], index_id: str, ref: str) -> None:
        """Write a generation beside its place, move it there, then point ``ref`` at it; older ones beyond the newest five
        that nothing refers to go."""
        staged, final = f"{self.root}/.staged-{index_id}", f"{self.root}/{index_id}"
        if self._fs.exists(self._path(final)):
            raise OSError(f"{final} is there already")
        snapshot.write(staged, names)
        if not self._fs.rename(self._path(staged), self._path(final)):
            raise OSError(f"{final} can't be made")
        state = self._read()
        state["order"] = [i for i in state["order"] if i != index_id] + [index_id]
        state["refs"][ref] = index_id
        keep = set(state["order"][-KEPT:]) | set(state["refs"].values())
        gone = [i for i in state["order"] if i not in keep]
        state["order"] = [i for i in state["order"] if i in keep]
        self._write(state)
        for i in gone:
            self._fs.delete(self._path(f"{self.root}/{i}"), True)

    def _write(self, state: dict) -> None:
        """References go to a file with the next number, which appears by a rename; the one before stays until then, so
        there are always whole ones. Of two writers at once the second fails."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        staged, target = self._path(f"{self.root}/.refs-{number}"), self._path(f"{self.root}/refs-{number}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            raise OSError(f"{self.root} has been written by another")
        for old in numbers[:-1]:
            self._fs.delete(self._path(f"{self.root}/refs-{old}.json"), False)

    def open(self, ref: str) -> Snapshot:
        """The generation that a reference points to."""
        return Snapshot.read(self.spark, f"{self.root}/{self._read()['refs'][ref]}")

    def generations(self) -> list[str]:
        return self._read()["order"]
