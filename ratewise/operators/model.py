"""A fitted model is a set of parameter tables plus a few scalars."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import clip
from ..session import broadcast_if_small, cut_lineage


@dataclass
class Model:
    """``tables`` hold the parameters (``users``, ``items`` and whatever the kind adds)."""

    kind: str
    tables: dict[str, DataFrame]
    meta: dict[str, Any]
    history: list[tuple[int, float]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession

    def users(self) -> DataFrame:
        return self.tables["users"]

    def items(self) -> DataFrame:
        return self.tables["items"]

    def bounds(self) -> tuple[float, float]:
        return float(self.meta["min_rating"]), float(self.meta["max_rating"])

    def bounded(self, prediction: Column, bound: bool) -> Column:
        return clip(prediction, *self.bounds()) if bound else prediction

    def about(self, items: DataFrame) -> "Model":
        """The model for pairs with these items only: where a prediction reads no other item, their parameters suffice."""
        if self.kind not in ("bias", "kernel_mf"):
            return self
        kept = cut_lineage(self.items().join(items.select("item_id"), "item_id", "left_semi"))
        return Model(self.kind, dict(self.tables, items=kept), dict(self.meta, n_items=kept.count()), self.history)

    def training_history(self) -> DataFrame:
        """RMSE on the training ratings per recorded epoch."""
        return self.spark.createDataFrame(self.history, "epoch int, train_rmse double")

    def save(self, path: str) -> None:
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        head = {"kind": self.kind, "meta": self.meta, "history": self.history, "tables": sorted(self.tables)}
        row = self.spark.createDataFrame([(json.dumps(head),)], "head string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/_model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        # the underscore folder is skipped by scans of the parent, not by a direct read
        head = json.loads(spark.read.parquet(f"{path}/_model").first()["head"])
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in head["tables"]}
        return Model(head["kind"], tables, head["meta"], [tuple(h) for h in head["history"]])


def attach_params(pairs: DataFrame, model: Model, user_columns: dict, item_columns: dict) -> DataFrame:
    """Left joins of user and item parameters; ``user_known`` / ``item_known`` tell what was found.

    A parameter side is broadcast only when its counted size fits.
    """
    width = 32 + 8 * int(model.meta.get("n_factors", 0))
    users = model.users().select(
        "user_id", *[F.col(c).alias(a) for c, a in user_columns.items()], F.lit(True).alias("user_known")
    )
    items = model.items().select(
        "item_id", *[F.col(c).alias(a) for c, a in item_columns.items()], F.lit(True).alias("item_known")
    )
    out = pairs.join(broadcast_if_small(users, model.meta["n_users"], width), "user_id", "left")
    out = out.join(broadcast_if_small(items, model.meta["n_items"], width), "item_id", "left")
    return out.withColumns(
        {
            "user_known": F.coalesce("user_known", F.lit(False)),
            "item_known": F.coalesce("item_known", F.lit(False)),
        }
    )
