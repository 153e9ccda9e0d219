"""The entry point: a graph and its query language."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weft.cypher import ast as A
from weft.cypher.ast import CypherError
from weft.cypher.parser import parse
from weft.plans.catalog import Catalog
from weft.plans.compile import Compiler


def procedures() -> dict:
    from weft.algo import PROCEDURES
    from weft.search import PROCEDURES as SEARCH

    return {**PROCEDURES, **SEARCH}


class GraphSession:
    """Queries over a catalog. Reading gives a lazy DataFrame; writing swaps in a new catalog when it has succeeded.

    ``uniqueness`` is "match" (no relationship twice in one MATCH) or "segment" (only within a variable-length one).
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, uniqueness: str = "match"):
        self.spark, self.catalog, self.uniqueness = spark, catalog or Catalog(spark), uniqueness
        self.parsed: dict[str, Any] = {}

    def parse(self, text: str) -> Any:
        if text not in self.parsed:
            if len(self.parsed) >= 1024:
                self.parsed.pop(next(iter(self.parsed)))
            self.parsed[text] = parse(text)
        return self.parsed[text]

    def compiler(self, params: dict[str, Any] | None = None) -> Compiler:
        return Compiler(self.catalog, params, self.uniqueness, procedures())

    def cypher(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        q = self.parse(text)
        if isinstance(q, A.Schema):
            from weft.plans.write import schema

            return schema(self, q)
        if isinstance(q, A.Explain):
            return self.explain(q, params)
        from weft.plans.write import is_write, run_write

        if is_write(q):
            return run_write(self, q, params)
        return self.compiler(params).query(q)

    def explain(self, q: A.Explain, params: dict[str, Any] | None) -> DataFrame:
        """The operators of the query as a tree, the optimizer's estimate and the physical plan, one line a row.

        PROFILE runs the query and adds its rows and seconds, and the rows of each physical operator.
        """
        import time

        from weft.plans.explain import estimates, operators, profile

        df = self.compiler(params).query(q.query)
        lines = [*operators(q.query.parts), estimates(df)]
        if q.mode == "PROFILE":
            began = time.time()
            n, ran = profile(df)
            lines += [f"rows {n}, seconds {time.time() - began:.3f}", *ran]
        mode = "extended" if q.mode in ("VERBOSE", "RAW") else "formatted"
        text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return self.spark.createDataFrame([(i, x) for i, x in enumerate(lines + text.splitlines())], "line int, plan string")

    def rows(self, text: str, params: dict[str, Any] | None = None, max_rows: int | None = None, seconds: float | None = None) -> list:
        """The rows of a statement, under limits: more than ``max_rows`` rows or running longer than ``seconds`` is an error.

        The limits hold for all jobs of the statement, those that it runs while it is compiled too.
        """
        import threading
        import uuid

        tag, late = f"weft-{uuid.uuid4().hex}", threading.Event()
        timer = None
        if seconds is not None:

            def stop() -> None:
                late.set()
                while not done.wait(0.2):  # jobs that start later are stopped as well
                    self.spark.sparkContext.cancelJobsWithTag(tag)

            done = threading.Event()
            timer = threading.Timer(seconds, stop)
            timer.daemon = True
        self.spark.sparkContext.addJobTag(tag)
        try:
            if timer:
                timer.start()
            df = self.cypher(text, params)
            out = (df if max_rows is None else df.limit(max_rows + 1)).collect()
        except Exception as e:
            if late.is_set():
                raise CypherError(f"the statement ran longer than {seconds} seconds") from e
            raise
        finally:
            if timer:
                done.set()
                timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        if late.is_set():
            raise CypherError(f"the statement ran longer than {seconds} seconds")
        if max_rows is not None and len(out) > max_rows:
            raise CypherError(f"the statement gives more than {max_rows} rows")
        return out

    def cursor_page(self, text: str, params: dict[str, Any] | None = None, cursor: str | None = None, size: int = 500) -> tuple[DataFrame, str | None]:
        """A page of ``size`` rows (0: all) behind the ``v1:`` cursor, and the cursor of the next one or None at the end.

        The statement needs an ORDER BY that tells all rows apart for pages to fit together.
        """
        version, _, skip = (cursor or "v1:0").partition(":")
        if version != "v1" or not skip.isdigit():
            raise CypherError(f"no cursor: {cursor!r}")
        df = self.cypher(text, params).offset(int(skip))
        if size == 0:
            return df, None
        page = df.limit(size)
        return page, f"v1:{int(skip) + size}" if page.count() == size else None

    def page(self, text: str, params: dict[str, Any] | None, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
        """Keyset pages: rows in order of ``keys`` (unique together) that come behind the key of the last row seen."""
        from pyspark.sql import functions as F

        df = self.cypher(text, params)
        if after is not None:
            behind, same = F.lit(False), F.lit(True)
            for k, v in zip(keys, after):
                behind = behind | (same & (F.col(k) > F.lit(v)))
                same = same & (F.col(k) == F.lit(v))
            df = df.where(behind)
        return df.orderBy(*keys).limit(size)


__all__ = ["CypherError", "GraphSession"]
