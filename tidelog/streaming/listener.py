"""Progress of streams as rows: what a metrics system scrapes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, rows long, rows_per_second double, duration_ms long"


class Progress(StreamingQueryListener):
    """Keeps the last `depth` batches of all queries, and the queries that ended with an error."""

    def __init__(self, depth: int = 1000) -> None:
        self.depth, self.rows, self.errors, self.idle = depth, [], [], 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        self.rows.append((p.get("name") or p["id"], p["batchId"], p.get("numInputRows", 0), float(p.get("processedRowsPerSecond", 0) or 0), p.get("durationMs", {}).get("triggerExecution", 0)))
        del self.rows[: -self.depth]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.idle += 1

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.errors.append(event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def text(self) -> str:
        """The totals in the text form that scrapers read."""
        total: dict[str, int] = {}
        for name, _, n, *_ in self.rows:
            total[name] = total.get(name, 0) + n
        return "".join(f'stream_rows_total{{query="{k}"}} {v}\n' for k, v in sorted(total.items()))
