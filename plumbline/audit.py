"""One audit of one store: catalog rules, evidence on the data, scores and what to do next.

    audit = (
        Audit(spark, "warehouse")
        .catalog(frames, primary_keys, foreign_keys, indexes)
        .rules()
        .evidence(unique=[("lineitem", ["l_orderkey", "l_linenumber"])])
    )
    audit.scores().show()
    audit.next_actions().orderBy("priority", "id").show()

Every step adds findings; the checks run once, when a result is first asked for.  Checks whose input was not
given appear as ``needs_api``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import constant_frame, cut_lineage
from plumbline.operators import catalog_rules, integrity, profile, scoring, state_rules
from plumbline.sources.catalog import catalog_from_frames

ForeignKey = tuple[str, str, str, str]  # child table, fk column, parent table, pk column

# Checks that need more than a catalog: rule -> (input, module, severity).
NEEDS = {
    "orphan_rows": ("evidence", "M3", 5),
    "duplicate_keys": ("evidence", "M2", 4),
    "index_unused": ("metrics", "M12", 3),
    "vacuum_wraparound": ("metrics", "M18", 5),
    "pool_capacity": ("metrics", "M15", 4),
    "conn_insecure": ("config", "M10", 4),
}
FINDING_COLUMNS = ["store", "id", "module", "status", "severity", "axis", "confidence", "magnitude", "fixable", "object"]


class Audit:
    def __init__(self, spark: SparkSession, store: str = "warehouse", paradigm: str = "relational"):
        self.spark = spark
        self.store = store
        self.paradigm = paradigm
        self._frames: dict[str, DataFrame] = {}
        self._fks: list[ForeignKey] = []
        self._catalog: catalog_rules.Catalog | None = None
        self._parts: list[DataFrame] = []
        self._found: tuple[int, DataFrame] | None = None
        self._inputs: dict[str, DataFrame | None] = {"evidence": None, "metrics": None, "config": None, "data": None}

    def catalog(
        self,
        frames: dict[str, DataFrame],
        primary_keys: dict[str, list[str]],
        foreign_keys: list[ForeignKey] = (),
        indexes: list[tuple[str, str, list[str], bool]] = (),
    ) -> Audit:
        """Declare tables (as DataFrames), keys, foreign keys and indexes ``(table, name, columns, unique)``."""
        self._frames, self._fks = frames, list(foreign_keys)
        columns = catalog_from_frames(self.spark, frames, primary_keys, self.store)
        fks = constant_frame(
            self.spark,
            [(self.store, c, [f], p, [k], "RESTRICT", True) for c, f, p, k in foreign_keys],
            "store string, table_name string, columns array<string>, ref_table string, ref_columns array<string>, on_delete string, validated boolean",
        )
        made = constant_frame(
            self.spark,
            [(self.store, t, n, c, u) for t, n, c, u in indexes],
            "store string, table_name string, index_name string, columns array<string>, is_unique boolean",
        )
        self._catalog = catalog_rules.Catalog(columns, fks, made)
        self._inputs["data"] = next(iter(frames.values()), None)
        return self

    def rules(self, rules=None) -> Audit:
        """Catalog rules; all of them unless a list is given."""
        self._parts.append(catalog_rules.run_rules(self._catalog, rules).select(*FINDING_COLUMNS))
        return self

    def evidence(self, unique: list[tuple[str, list[str]]] = ()) -> Audit:
        """Orphans of every declared foreign key, and uniqueness of the given column sets, on the data."""
        if self._fks:
            fks = [(f"{c}.{f}", self._frames[c], f, self._frames[p], k) for c, f, p, k in self._fks]
            matrix = integrity.orphan_matrix(fks).select(F.col("fk_name").alias("object"), F.col("orphans").alias("bad"))
            self._parts.append(self._measured(matrix, "M3", "orphans", 5))
        for table, columns in unique:
            keyed = profile.candidate_key_profile(self._frames[table], [columns])
            bad = keyed.select(
                F.lit(f"{table}.{'_'.join(columns)}").alias("object"), (F.col("rows") - F.col("distinct_values")).alias("bad")
            )
            self._parts.append(self._measured(bad, "M2", "duplicate_keys", 4))
        self._inputs["evidence"] = self._parts[-1]
        return self

    def metrics(self, history: DataFrame) -> Audit:
        """Metric rules over a history ``(store, object, metric, ts, value)``."""
        rows = state_rules.metric_rules(history)
        self._parts.append(rows.withColumns({"magnitude": F.lit("medium"), "fixable": F.lit("advisory")}).select(*FINDING_COLUMNS))
        self._inputs["metrics"] = history
        return self

    def config(self, settings: DataFrame) -> Audit:
        """Configuration rules over settings ``(store, key, value)``."""
        rows = state_rules.config_rules(settings)
        constant = {"axis": "both", "confidence": "directional", "magnitude": "medium", "fixable": "advisory"}
        self._parts.append(rows.withColumns({k: F.lit(v) for k, v in constant.items()}).withColumn("object", F.col("store")).select(*FINDING_COLUMNS))
        self._inputs["config"] = settings
        return self

    def _measured(self, counted: DataFrame, module: str, rule: str, severity: int) -> DataFrame:
        """Counts of bad rows ``(object, bad)`` as established findings: none is a pass."""
        return counted.select(
            F.lit(self.store).alias("store"),
            F.concat(F.lit(f"{module}."), F.lower("object"), F.lit(f"_{rule}")).alias("id"),
            F.lit(module).alias("module"),
            F.when(F.col("bad") > 0, "fail").otherwise("pass").alias("status"),
            F.lit(severity).alias("severity"),
            F.lit("both").alias("axis"),
            F.lit("established").alias("confidence"),
            F.lit("high").alias("magnitude"),
            F.lit("proposed").alias("fixable"),
            "object",
        )

    def findings(self) -> DataFrame:
        """All findings, one per id, unproven checks included.  They are written to the shared folder
        once, so that scores, actions and checklist do not run the checks again."""
        if self._found is None or self._found[0] != len(self._parts):
            self._found = len(self._parts), cut_lineage(self._all_findings(), "findings")
        return self._found[1]

    def _all_findings(self) -> DataFrame:
        here = self.spark.range(1).select(F.lit(self.store).alias("store"))
        missing = state_rules.stamp_missing(self.spark, here, self._inputs, NEEDS)
        constant = {"axis": "both", "confidence": "speculative", "magnitude": "medium", "fixable": "advisory"}
        stamped = missing.withColumns({k: F.lit(v) for k, v in constant.items()}).withColumn("object", F.col("store")).select(*FINDING_COLUMNS)
        every = reduce(DataFrame.unionByName, [*self._parts, stamped])
        return scoring.dedupe_findings(every.withColumn("paradigm", F.lit(self.paradigm)))

    def scores(self) -> DataFrame:
        return scoring.axis_scores(self.findings())

    def next_actions(self) -> DataFrame:
        return scoring.next_actions(self.findings())

    def checklist(self) -> DataFrame:
        return scoring.readiness_checklist(self.findings())
