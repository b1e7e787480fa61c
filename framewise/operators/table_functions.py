"""A detector as a table function: `select * from detect(table(frames) partition by video_id order by frame)`.

The input has video_id, frame and content (and what else the model wants to see);
each partition is a video, in which frames reach the model in batches. Any model
that maps a list of rows to a list of boxes for each will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schema import VEHICLES
from ..shipping import ship

#: A box: class, edges and confidence.
Found = tuple[int, int, int, int, int, float]
Model = Callable[[Sequence[Row]], Sequence[Sequence[Found]]]
NEEDED = ("video_id", "frame", "content")


def register(spark: SparkSession, model: Model, name: str = "detect", batch: int = 16) -> None:
    """Make a model known as a table function of `frames` that gives vehicles (or plates) as `schema.VEHICLES`."""
    ship(spark)
    result = StructType.fromDDL(VEHICLES)

    class Detect:
        def __init__(self):
            self.held: list[Row] = []

        @staticmethod
        def analyze(frames: AnalyzeArgument) -> AnalyzeResult:
            if not frames.isTable:
                raise ValueError("a table of frames is needed: detect(table(...))")
            missing = [c for c in NEEDED if c not in frames.dataType.fieldNames()]
            if missing:
                raise ValueError(f"frames have no {', '.join(missing)}")
            return AnalyzeResult(result)

        def eval(self, row: Row) -> Iterator[tuple]:
            self.held.append(row)
            if len(self.held) == batch:
                yield from self._run()

        def terminate(self) -> Iterator[tuple]:
            if self.held:
                yield from self._run()

        def _run(self) -> Iterator[tuple]:
            rows, self.held = self.held, []
            for row, boxes in zip(rows, model(rows), strict=True):
                for n, (cls, x1, y1, x2, y2, conf) in enumerate(boxes):
                    yield row.video_id, row.frame, n, cls, x1, y1, x2, y2, conf

    spark.udtf.register(name, udtf(Detect))
