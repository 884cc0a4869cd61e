"""The curation batch: seed, stories, ranking, sample, exports, coverage, quality, manifest, over one folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vocab
from ..operators import clustering, ranking, reports, tables
from ..sources import readers, sinks, versions


class Workspace:
    """A folder of Parquet tables and outputs, local or in any store that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def load(self, name: str, schema: str) -> DataFrame:
        return versions.read(self.spark, self.path("tables", name), schema)

    def save(self, name: str, df: DataFrame) -> None:
        """The new version is written beside the old one before its marker, so it may be made from the old one."""
        versions.write(df, self.path("tables", name))

    def articles(self) -> DataFrame:
        return self.load("articles", schemas.ARTICLES)

    def sample(self) -> DataFrame:
        return self.load("sample_memberships", schemas.SAMPLES)


def init(ws: Workspace) -> None:
    for name, schema in (("articles", schemas.ARTICLES), ("story_clusters", schemas.CLUSTERS), ("evidence_objects", schemas.EVIDENCE), ("crawl_partitions", schemas.PARTITIONS), ("sample_memberships", schemas.SAMPLES), ("translation_queue", schemas.TRANSLATIONS)):
        ws.save(name, ws.load(name, schema))


def import_seed(ws: Workspace, path: str) -> dict:
    """Upsert a Markdown seed; repeated record ids in it are an error."""
    rows = readers.seed(ws.spark, path)
    stats = readers.seed_stats(rows).first().asDict()
    if stats["parsed"] != stats["unique"]:
        raise ValueError(f"seed holds {stats['parsed']} rows of {stats['unique']} records")
    ws.save("articles", tables.upsert(ws.articles(), rows, ["record_id"]).select(*ws.articles().columns))
    return stats


def cluster(ws: Workspace) -> None:
    made = clustering.assign_story_ids(ws.articles())
    known = ws.load("story_clusters", schemas.CLUSTERS)
    new = clustering.clusters(made).withColumn("manual_status", F.lit("unreviewed"))
    ws.save("story_clusters", clustering.keep_known(known, new).select(*known.columns))
    ws.save("articles", made.drop("cluster_method"))


def sample(ws: Workspace, as_of: str, sample_id: str = "main", target: int = vocab.TARGET, require_body: bool = True) -> None:
    old = ws.sample()
    new = ranking.monthly_sample(ws.articles(), target, require_body).withColumns({"sample_id": F.lit(sample_id), "selected_at": F.lit(as_of)})
    ws.save("sample_memberships", old.where(F.col("sample_id") != sample_id).unionByName(new.select(*old.columns)))


def plan_hydration(ws: Workspace, per_month: int = 10) -> None:
    rows = ranking.hydration_candidates(ws.articles(), per_month).select("record_id", "source_code", "year_month", "rank", "score", "original_url")
    rows.orderBy("source_code", "year_month", "rank").write.mode("overwrite").option("header", True).csv(ws.path("catalog", "hydration_candidates"))


def queue_translations(ws: Workspace, as_of: str) -> None:
    old = ws.load("translation_queue", schemas.TRANSLATIONS)
    members = tables.retain_members(old, ws.sample(), "record_id")
    new = tables.translation_queue(ws.articles(), ws.sample()).withColumn("queued_at", F.lit(as_of))
    kept = [c for c in old.columns if c not in ("record_id", *[c for c in new.columns if c != "record_id"])]
    ws.save("translation_queue", tables.upsert_preserving(members, new, "record_id", [c for c in new.columns if c != "record_id"], kept).select(*old.columns))


def export(ws: Workspace) -> None:
    ws.save("articles", sinks.export_records(ws.articles(), ws.path("records")))
    sinks.export_json(ws.articles(), ws.path("catalog", "articles_json"))
    sinks.export_csv(ws.articles(), ws.path("catalog", "articles_csv"))
    reports.monthly_coverage(ws.articles(), ws.sample()).orderBy("source", "year_month").write.mode("overwrite").option("header", True).csv(ws.path("catalog", "monthly_coverage"))
    reports.backfill_queue(ws.articles(), ws.load("crawl_partitions", schemas.PARTITIONS)).orderBy("source", "year_month").write.mode("overwrite").option("header", True).csv(ws.path("audit", "historical_backfill_queue"))


def quality(ws: Workspace) -> DataFrame:
    relations = {n: (ws.load(n, s), c) for n, s, c in (("story_clusters", schemas.CLUSTERS, "representative_record_id"), ("evidence_objects", schemas.EVIDENCE, "record_id"), ("sample_memberships", schemas.SAMPLES, "record_id"), ("translation_queue", schemas.TRANSLATIONS, "record_id"))}
    found = reports.findings(reports.quality_checks(ws.articles(), ws.sample(), relations, ws.load("crawl_partitions", schemas.PARTITIONS)))
    found.write.mode("overwrite").json(ws.path("audit", "quality"))
    return found


def inventory(ws: Workspace) -> None:
    for name, df in (("source_year", reports.source_year_inventory(ws.articles(), ws.sample())), ("family_year", reports.family_year_inventory(ws.articles(), ws.sample())), ("family", reports.family_totals(ws.articles()))):
        df.write.mode("overwrite").option("header", True).csv(ws.path("catalog", f"{name}_inventory"))


def status_report(ws: Workspace) -> str:
    return sinks.report("Status", {"Years": reports.yearly_status(ws.articles(), ws.sample()).orderBy("source", "year"), "Coverage": reports.coverage_by_year(ws.sample()).orderBy("source", "year")})


def bootstrap(ws: Workspace, seed: str, as_of: str) -> str:
    """The whole batch; running it again changes nothing."""
    init(ws)
    import_seed(ws, seed)
    cluster(ws)
    plan_hydration(ws)
    sample(ws, as_of)
    queue_translations(ws, as_of)
    export(ws)
    quality(ws)
    inventory(ws)
    return sinks.manifest({"articles": ws.articles(), "sample_memberships": ws.sample()}, {"as_of": as_of})
