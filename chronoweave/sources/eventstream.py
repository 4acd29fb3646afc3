"""XML event streams to source events, and source events to the source graph's nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.ids import source_event_id
from chronoweave.functions.text import any_date
from chronoweave.schemas import ELIGIBILITY, EVENTSTREAM

FIELDS = ["type", "code", "name", "unit", "visit_id", "provider_id", "care_site_id", "note_id", "procedure_id", "image_id"]


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """One row for each <eventstream> of the files, with a fixed schema; a file that does not parse gives a row of nulls."""
    return spark.read.format("xml").options(rowTag="eventstream", attributePrefix="_", valueTag="_VALUE", ignoreSurroundingSpaces="false", mode="PERMISSIVE").schema(EVENTSTREAM).load(path)


def parse_streams(texts: DataFrame, column: str) -> DataFrame:
    """The same from a column of XML texts."""
    options = {"rowTag": "eventstream", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
    return texts.select(F.from_xml(column, EVENTSTREAM, options).alias("s")).select("s.*")


def events(streams: DataFrame) -> DataFrame:
    """Source events in document order: encounters, entries and events, flattened.

    seq (encounter, entry, event) is the document order that ties follow. Missing attributes are ''; events without a type go.
    """
    encounter = streams.select(F.col("_person_id").alias("patient_id"), F.posexplode("encounter").alias("_i", "_e"))
    entry = encounter.select("patient_id", "_i", F.posexplode("_e.events.entry").alias("_j", "_n"))
    each = entry.select("patient_id", "_i", "_j", F.col("_n._timestamp").alias("timestamp"), F.posexplode("_n.event").alias("_k", "_x")).where("_x._type is not null")
    own = {f: F.coalesce(F.col(f"_x._{f}"), F.lit("")) for f in FIELDS}
    stamp = F.coalesce("timestamp", F.lit(""))
    return each.select(
        "patient_id",
        F.struct(F.col("_i").alias("encounter"), F.col("_j").alias("entry"), F.col("_k").alias("event")).alias("seq"),
        stamp.alias("timestamp"),
        F.substring(stamp, 1, 10).alias("date"),
        F.substring(stamp, 12, 5).alias("time"),
        *[own[f].alias(f) for f in FIELDS],
        F.coalesce("_x._VALUE", F.lit("")).alias("value"),
        source_event_id(own["type"], stamp, own["code"], own["name"], own["note_id"], own["procedure_id"], own["image_id"], own["visit_id"]).alias("node_id"),
    )


def people(streams: DataFrame) -> DataFrame:
    """Demographics of each patient's first encounter."""
    p = F.col("encounter")[0]["person"]
    return streams.select(
        F.col("_person_id").alias("patient_id"), p["birthdate"].alias("birthdate"), p["age"]["years"].try_cast("double").alias("age_years"),
        F.initcap(p["demographics"]["gender"]).alias("gender"), p["demographics"]["race"].alias("race"), p["demographics"]["ethnicity"].alias("ethnicity"),
    )


def care_sites(streams: DataFrame) -> DataFrame:
    each = streams.select(F.col("_person_id").alias("patient_id"), F.explode("encounter").alias("_e"))
    return each.select("patient_id", F.explode("_e.caresites.caresite").alias("_c")).select("patient_id", F.col("_c._care_site_id").alias("care_site_id"), F.col("_c._care_site_name").alias("care_site_name")).distinct()


def before_cutoff(events_: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Events before the first entry, in document order, dated at or after the patient's cutoff.

    The cut is one of place: earlier-dated entries after it go as well; entries without a readable date never cut. Patients
    without a cutoff keep all.
    """
    met = events_.join(cutoffs, "patient_id", "left")
    place = F.struct("seq.encounter", "seq.entry")
    cut = F.min(F.when(F.try_to_date("date", "yyyy-MM-dd") >= F.col("cutoff"), place)).over(W.partitionBy("patient_id"))
    return met.withColumn("_cut", cut).where(F.col("_cut").isNull() | (place < F.col("_cut"))).drop("_cut", "cutoff")


def only_types(events_: DataFrame, kept: list[str]) -> DataFrame:
    return events_.where(F.col("type").isin(kept))


def nodes(events_: DataFrame) -> DataFrame:
    """One node for each id: events (of equal ids the later one's attributes, the earlier one's place) and visits."""
    attributes = F.create_map(*[x for f in [*FIELDS, "value", "timestamp", "date"] for x in (F.lit(f), F.col(f))])
    of_events = events_.withColumn("attrs", attributes).groupBy("patient_id", "node_id").agg(F.lit("Event").alias("node_type"), F.max_by("attrs", "seq").alias("attrs"), F.min("seq").alias("seq"))
    visits = events_.where("visit_id <> ''").groupBy("patient_id", F.concat(F.lit("visit_node_"), "visit_id").alias("node_id")).agg(
        F.lit("Visit").alias("node_type"),
        F.create_map(F.lit("visit_id"), F.min("visit_id"), F.lit("event_count"), F.count("*").cast("string"), F.lit("date"), F.min("date"), F.lit("care_site_id"), F.min_by("care_site_id", "seq")).alias("attrs"),
        F.min("seq").alias("seq"),
    )
    return of_events.unionByName(visits)


def edges(events_: DataFrame) -> DataFrame:
    """PRECEDES, VISIT_CONTAINS, PROCEDURE_FOR and IMAGE_REPORT_FOR edges of the source graph."""
    e = events_.groupBy("patient_id", "node_id").agg(F.min("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in ("timestamp", "date", "type", "name", "visit_id", "procedure_id")])
    along = W.partitionBy("patient_id").orderBy("timestamp", "seq")
    link = lambda df, a, b, kind: df.select("patient_id", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type"))
    follows = e.withColumn("next", F.lead("node_id").over(along)).where("next is not null")
    contains = e.where("visit_id <> ''").withColumn("visit", F.concat(F.lit("visit_node_"), "visit_id"))
    images = e.where("type = 'image'").select("patient_id", F.col("node_id").alias("image"), F.col("date").alias("image_date"), "visit_id", "procedure_id")
    procedures = e.where("type = 'procedure' and procedure_id <> ''").select("patient_id", "procedure_id", F.col("node_id").alias("procedure"))
    of_procedure = images.where("procedure_id <> ''").join(procedures, ["patient_id", "procedure_id"])
    reports = e.where("type = 'note'").where(radiology(F.col("name"))).select("patient_id", F.col("node_id").alias("note"), "visit_id", "date")
    by_visit = reports.where("visit_id <> ''").join(images.where("visit_id <> ''"), ["patient_id", "visit_id"])
    by_date = reports.where("visit_id = ''").drop("visit_id").join(images.where("procedure_id <> ''").withColumnRenamed("image_date", "date"), ["patient_id", "date"])
    parts = [
        link(follows, "node_id", "next", "PRECEDES"),
        link(contains, "visit", "node_id", "VISIT_CONTAINS"),
        link(of_procedure, "image", "procedure", "PROCEDURE_FOR"),
        link(by_visit, "note", "image", "IMAGE_REPORT_FOR"),
        link(by_date, "note", "image", "IMAGE_REPORT_FOR"),
    ]
    return reduce(DataFrame.unionByName, parts)


def radiology(name: Column, strict: bool = True) -> Column:
    """Whether a note's name is that of an imaging report: whole words, or with strict off the bare substrings."""
    low = F.lower(name)
    terms = ["ct", "mri", "pet", "xr", "x-ray", "ultrasound", "imaging", "radiology"]
    if strict:
        return low.rlike(r"(^|[^a-z])(" + "|".join(terms) + r")([^a-z]|$)")
    return reduce(lambda a, b: a | b, [low.contains(t) for t in terms])


def eligible(spark: SparkSession, path: str, first_year: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """patient_id and date of a CSV with one of four date formats; patients in `done` are left out."""
    rows = spark.read.schema(ELIGIBILITY).option("header", True).csv(path)
    out = rows.select("patient_id", any_date(F.col("first_tb_encounter_date")).alias("cutoff")).where("cutoff is not null")
    out = out if first_year is None else out.where(F.year("cutoff") >= first_year)
    return out if done is None else out.join(done.select("patient_id"), "patient_id", "left_anti")


def write_graph(nodes_: DataFrame, edges_: DataFrame, path: str, buckets: int = 64) -> None:
    """Node and edge tables by hash of the patient, so that one patient's graph is one pruned directory."""
    bucket = F.pmod(F.hash("patient_id"), F.lit(buckets)).alias("bucket")
    nodes_.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/nodes")
    edges_.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/edges")


def read_patient(spark: SparkSession, path: str, patient: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """A patient's nodes and edges; only one bucket is read."""
    own = spark.range(1).select(F.pmod(F.hash(F.lit(patient)), F.lit(buckets))).first()[0]
    pick = lambda name: spark.read.parquet(f"{path}/{name}").where((F.col("bucket") == own) & (F.col("patient_id") == patient)).drop("bucket")
    return pick("nodes"), pick("edges")
