"""Control plane: the state of backends from a log of commands, and what follows for routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EALREADY, EBUSY
from .routes import upsert

#: Commands and the state they lead to.
STATES = {"enable": "enabled", "disable": "disabled", "readonly": "readonly", "writable": "enabled"}


def results(log: DataFrame, keys: tuple[str, ...] = ("group_id", "backend_id")) -> DataFrame:
    """The log in order with the state after each command, and its status: an error if it changes nothing."""
    state = F.coalesce(*[F.when(F.col("command") == c, F.lit(s)) for c, s in STATES.items()])
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = log.withColumn("state", state).filter("state IS NOT NULL")
    return rows.withColumn("status", F.when(F.lag("state").over(w).eqNullSafe(F.col("state")), F.lit(-EALREADY)).otherwise(F.lit(0)))


def current(log: DataFrame, keys: tuple[str, ...] = ("group_id", "backend_id")) -> DataFrame:
    """(keys, state, seq): each backend's last state."""
    rows = results(log, keys)
    return rows.groupBy(*keys).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def enabled_routes(routes: DataFrame, states: DataFrame) -> DataFrame:
    """Routes of backends that are not disabled."""
    return routes.join(states.filter("state = 'disabled'").select("group_id", "backend_id"), ["group_id", "backend_id"], "left_anti")


def set_ids(routes: DataFrame, states: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give backends new boundaries: (status of each backend in ``change``, routes afterwards).

    An enabled (or read-only) backend's routes are replaced at once; a disabled one's are
    only stored for later; one between states is busy.
    """
    own = change.select("group_id", "backend_id").distinct().join(states.select("group_id", "backend_id", "state"), ["group_id", "backend_id"], "left")
    status = F.when(F.col("state").isin("enabled", "readonly", "disabled") | F.col("state").isNull(), F.lit(0)).otherwise(F.lit(-EBUSY))
    own = own.select("group_id", "backend_id", status.alias("status"), F.coalesce(F.col("state").isin("enabled", "readonly"), F.lit(True)).alias("at_once"))
    return own.select("group_id", "backend_id", "status"), upsert(routes, change.join(own.filter("at_once"), ["group_id", "backend_id"], "left_semi"))
