"""Settings of the engine: typed, bounded, with a history, stored as tables; and a nested settings file with dot paths."""

from __future__ import annotations

import copy
import datetime
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import WEIGHTS, completed
from tessera.sources.sinks import Versions


@dataclass(frozen=True)
class Setting:
    """One setting: its type, what it is unless set, what it may be, whether it may be set, and whether a change needs a restart."""

    name: str
    kind: type
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple | None = None
    editable: bool = True
    restart: bool = False

    def parsed(self, value: Any) -> Any:
        """value in the setting's type; ValueError if it can't be, or is outside the bounds or choices."""
        if self.kind is bool:
            value = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
        value = self.kind(value)
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{self.name} must be within {self.low} and {self.high}")
        if self.choices is not None and value not in self.choices:
            raise ValueError(f"{self.name} must be one of {self.choices}")
        return value


def _all(kind: type, restart: bool, *rows: tuple, editable: bool = True) -> tuple[Setting, ...]:
    return tuple(Setting(r[0], kind, r[1], *(r[2:4] or (None, None)), editable=editable, restart=restart) for r in rows)


EMBEDDERS = ("sentence-transformers/all-MiniLM-L6-v2", "sentence-transformers/all-mpnet-base-v2", "sentence-transformers/multi-qa-MiniLM-L6-cos-v1")
UPLOADS = "txt,pdf,docx,md,html,json,csv,xml,log,py,js,java,cpp,c,h"

#: Names, defaults and bounds of the 52 settings; at the end the engine's own.
SETTINGS = {
    s.name: s
    for s in (
        *_all(bool, False, ("use_attention", True), ("use_liquid_clusters", True), ("use_multi_part", True)),
        *_all(bool, True, ("use_llama_embeddings", True), ("continuous_batching", True)),
        *_all(float, False, ("w_semantic", 0.68, 0.0, 1.0), ("w_recency", 0.10, 0.0, 1.0), ("w_actor", 0.07, 0.0, 1.0), ("w_spatial", 0.03, 0.0, 1.0), ("w_usage", 0.05, 0.0, 1.0)),
        *_all(int, False, ("memory_budget", 20480, 100, 100000), ("context_window", 20480, 2048, 32768), ("reserve_output_tokens", 1024, 256, 4096), ("reserve_system_tokens", 512, 128, 2048)),
        *_all(float, False, ("cluster_flow_rate", 0.1, 0.01, 0.5), ("cluster_merge_threshold", 0.85, 0.5, 0.99), ("cluster_energy_decay", 0.99, 0.9, 0.999), ("hebbian_rate", 0.01, 0.001, 0.1), ("synaptic_decay", 0.001, 0.0001, 0.01), ("embed_momentum", 0.95, 0.8, 0.99), ("drift_blend", 0.3, 0.0, 0.5), ("mmr_lambda", 0.5, 0.0, 1.0)),
        *_all(int, True, ("web_port", 5001, 1024, 65535), ("api_port", 8001, 1024, 65535), ("llama_port", 8000, 1024, 65535)),
        *_all(int, False, ("cache_ttl", 300, 0, 3600), ("rate_limit_requests", 100, 10, 1000), ("rate_limit_window", 60, 1, 600)),
        *_all(float, False, ("default_temperature", 0.1, 0.0, 2.0), ("default_repetition_penalty", 1.2, 0.0, 2.0), ("default_top_p", 0.9, 0.0, 1.0)),
        *_all(int, False, ("default_max_tokens", 512, 10, 4096), ("default_top_k", 40, 0, 200), ("multi_part_threshold", 200, 50, 1000), ("attention_heads", 8, 1, 16), ("extraction_batch_size", 8, 1, 32), ("embedding_batch_size", 64, 8, 256)),
        *_all(int, True, ("max_upload_size", 52428800, 1048576, 524288000), ("embedding_dim", 1024, 128, 4096), ("gpu_layers", -1, -1, 100), ("llama_batch_size", 4096, 512, 8192), ("llama_ubatch_size", 1024, 128, 2048), ("parallel_sequences", 8, 1, 16)),
        *_all(str, True, ("upload_extensions", UPLOADS), ("model_path", ""), ("embedding_model_path", "")),
        *_all(str, False, ("llm_base_url", "http://localhost:8000/v1"), ("llm_model", "Qwen3-4b-instruct-2507")),
        *_all(str, True, ("db_path", "./data/amemory.sqlite3"), ("index_path", "./data/faiss.index"), editable=False),
        *_all(int, True, ("embed_dim", 1024), editable=False),
        Setting("embed_model", str, EMBEDDERS[0], choices=EMBEDDERS, restart=True),
        Setting("topk_semantic", int, 60, 1, 1 << 20),
        Setting("half_life_hours", float, 168.0, 0.01, 1e6),
        Setting("grouping", str, "intended", choices=("intended", "literal", "off")),
        *(Setting(f"weight_{k}", float, v, 0.0, 1.0) for k, v in WEIGHTS.items()),
    )
}
HISTORY = "id long, key string, old_value string, new_value string, changed_at string, changed_by string, reason string"


def history(rows: DataFrame, key: str | None = None, limit: int = 50) -> DataFrame:
    """Changes (HISTORY), those of one key or of all, newest first, the first limit of them."""
    return (rows if key is None else rows.where(F.col("key") == key)).orderBy(F.col("changed_at").desc(), F.col("id").desc()).limit(limit)


@dataclass
class Config:
    """Current values and the log of changes; stored as two tables, in versions."""

    values: dict[str, Any] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def get(self, name: str) -> Any:
        return self.values.get(name, SETTINGS[name].default)

    def set(self, name: str, value: Any, by: str = "user", why: str = "") -> None:
        if not SETTINGS[name].editable:
            raise ValueError(f"{name} can't be changed")
        new = SETTINGS[name].parsed(value)
        self._logged(name, self.get(name), new, by, why)
        self.values[name] = new

    def _logged(self, name: str, old: Any, new: Any, by: str, why: str) -> None:
        self.log.append({"key": name, "old": old, "new": new, "at": datetime.datetime.now(datetime.UTC).isoformat(), "by": by, "why": why})

    def reset(self, name: str | None = None, by: str = "user") -> None:
        for key in [*self.values] if name is None else [name] if name in self.values else []:
            self._logged(key, self.values.pop(key), SETTINGS[key].default, by, "reset")

    def history(self, name: str | None = None, limit: int = 50) -> list[dict]:
        return [x for x in reversed(self.log) if name in (None, x["key"])][:limit]

    def weights(self) -> dict[str, float]:
        return completed({k: self.get(f"weight_{k}") for k in WEIGHTS})

    def dumps(self) -> str:
        """All values with their defaults, as JSON."""
        return json.dumps({k: {"value": self.get(k), "default": s.default} for k, s in SETTINGS.items()}, indent=2)

    def loads(self, text: str, by: str = "user") -> dict[str, str | None]:
        """Sets what dumps() gave; for each known key None, or what is wrong with it."""
        out: dict[str, str | None] = {}
        for key, x in json.loads(text).items():
            if key in SETTINGS and "value" in x and x["value"] != self.get(key):
                try:
                    self.set(key, x["value"], by, "imported")
                    out[key] = None
                except ValueError as e:
                    out[key] = str(e)
        return out

    def save(self, overrides: Versions, changes: Versions) -> None:
        """Writes the values that aren't defaults, and the log, each as a new version."""
        spark, at = overrides.spark, {x["key"]: x for x in self.log}
        rows = [(k, json.dumps(v), at.get(k, {}).get("at", ""), at.get(k, {}).get("by", "")) for k, v in self.values.items()]
        overrides.write(spark.createDataFrame(rows, "key string, value string, updated_at string, updated_by string"))
        log = [(i, x["key"], json.dumps(x["old"]), json.dumps(x["new"]), x["at"], x["by"], x["why"]) for i, x in enumerate(self.log, 1)]
        changes.write(spark.createDataFrame(log, HISTORY))

    @classmethod
    def load(cls, overrides: Versions, changes: Versions) -> Config:
        """What save() wrote last; defaults if there is nothing."""
        out = cls()
        if overrides.numbers():
            out.values = {r.key: json.loads(r.value) for r in overrides.read().collect() if r.key in SETTINGS}  # a row for each setting at most
        if changes.numbers():
            rows = changes.read().orderBy("id").collect()  # changes that people made
            out.log = [{"key": r.key, "old": json.loads(r.old_value), "new": json.loads(r.new_value), "at": r.changed_at, "by": r.changed_by, "why": r.reason} for r in rows]
        return out


class Settings:
    """A nested dictionary over defaults."""

    def __init__(self, defaults: dict):
        self.defaults, self.data = defaults, copy.deepcopy(defaults)

    def get(self, path: str, other: Any = None) -> Any:
        at: Any = self.data
        for p in path.split("."):
            if not isinstance(at, dict) or p not in at:
                return other
            at = at[p]
        return at

    def set(self, path: str, value: Any) -> None:
        *way, last = path.split(".")
        at = self.data
        for p in way:
            at = at.setdefault(p, {})
        at[last] = value

    def merge(self, other: dict) -> None:
        def into(a, b):
            for k, v in b.items():
                a[k] = into(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v
            return a

        into(self.data, copy.deepcopy(other))

    def reset(self, section: str | None = None) -> None:
        if section is None:
            self.data = copy.deepcopy(self.defaults)
        else:
            self.data[section] = copy.deepcopy(self.defaults.get(section, {}))

    def dumps(self) -> str:
        return json.dumps(self.data, indent=2, sort_keys=True)

    def loads(self, text: str) -> None:
        self.reset()
        self.merge(json.loads(text))
