"""What is kept for a while beside tables: staged rows, cached tables, users and sessions."""

from __future__ import annotations

import json
import secrets
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import hash_password, verify_password
from .files import Store


class Staging:
    """Rows put aside under a name until they are taken."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.store.at(f"staging/{name}"))

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self.store.at(f"staging/{name}")) if self.store.exists(f"staging/{name}") else None

    def delete(self, name: str) -> bool:
        return self.store.delete(f"staging/{name}")


class Cached:
    """A table held in the executors' memory (and on disk beyond it) while it is used: each read puts its end off by
    `seconds`; none means until it is dropped. A new version of what it is made from makes it anew."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float | None = 300.0, version: Callable[[], object] = lambda: None, now: Callable[[], float] = time.monotonic):
        self._make, self._seconds, self._version, self._now = make, seconds, version, now
        self._df: DataFrame | None = None
        self._made_of: object = None
        self._end = 0.0

    @property
    def held(self) -> bool:
        return self._df is not None and (self._seconds is None or self._now() < self._end)

    def read(self) -> DataFrame:
        version = self._version()
        if not self.held or version != self._made_of:
            self.drop()
            self._df, self._made_of = self._make().persist(), version
        self._end = self._now() + (self._seconds or 0.0)
        return self._df

    def drop(self) -> None:
        if self._df is not None:
            self._df.unpersist()
            self._df = None


class Users:
    """Names with salted password hashes, and sessions that end; kept as a file of a catalog's folder."""

    def __init__(self, store: Store):
        self.store = store

    def _load(self) -> dict:
        return json.loads(self.store.read("users.json")) if self.store.exists("users.json") else {"users": {}, "sessions": {}}

    def _save(self, d: dict) -> None:
        self.store.replace("users.json", json.dumps(d, ensure_ascii=False))

    def add(self, name: str, password: str) -> bool:
        d = self._load()
        if not name or name in d["users"]:
            return False
        d["users"][name] = hash_password(password)
        self._save(d)
        return True

    def password(self, name: str, password: str) -> bool:
        d = self._load()
        if name not in d["users"]:
            return False
        d["users"][name] = hash_password(password)
        self._save(d)
        return True

    def delete(self, name: str) -> bool:
        d = self._load()
        found = d["users"].pop(name, None) is not None
        d["sessions"] = {k: s for k, s in d["sessions"].items() if s["user"] != name}
        self._save(d)
        return found

    def names(self) -> list[str]:
        return sorted(self._load()["users"])

    def verify(self, name: str, password: str | None) -> bool:
        d = self._load()
        return name in d["users"] and verify_password(password, d["users"][name])

    def connect(self, name: str, password: str | None, seconds: float = 86_400.0) -> str | None:
        """A session's token, or nothing if the password is wrong."""
        if not self.verify(name, password):
            return None
        d, token = self._load(), secrets.token_hex(16)
        d["sessions"] = {k: s for k, s in d["sessions"].items() if s["end"] > time.time()} | {token: {"user": name, "end": time.time() + seconds}}
        self._save(d)
        return token

    def user_of(self, token: str) -> str | None:
        s = self._load()["sessions"].get(token)
        return s["user"] if s and s["end"] > time.time() else None

    def disconnect(self, token: str) -> None:
        d = self._load()
        d["sessions"].pop(token, None)
        self._save(d)
