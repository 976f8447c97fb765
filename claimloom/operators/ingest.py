"""Uploads: validation, content addresses, registration, memberships and batch items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.textnorm import BLANK
from claimloom.operators.project import replace_rows
from claimloom.plans.lineage import cut
from claimloom.schemas import BOUNDS, Tables

MOST_BYTES = 100 * 1024 * 1024


def safe_filename(c: Column) -> Column:
    """The part after the last slash of either kind, trimmed; document.pdf for none."""
    last = F.regexp_replace(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[\\/]"), -1), f"^{BLANK}+|{BLANK}+$", "")
    return F.when(last == "", F.lit("document.pdf")).otherwise(last)


def reject_reason(filename: Column, size: Column, header: Column, most_bytes: int = MOST_BYTES) -> Column:
    """The first rule a file breaks, or null; header holds its first 1024 bytes."""
    return (
        F.when(~F.lower(filename).endswith(".pdf"), "Only PDF files are supported")
        .when(size > most_bytes, f"File exceeds the {most_bytes} byte limit")
        .when(size == 0, "File is empty")
        .when(F.instr(F.decode(header, "ISO-8859-1"), "%PDF-") == 0, "File is not a valid PDF")
    )


def _judged(files: DataFrame, most_bytes: int) -> DataFrame:
    """files with safe filename, size_bytes and error; a content that was not sent is empty. A file that could not be read says so in read_error, if there is such a column."""
    files = files.withColumn("content", F.coalesce("content", F.lit(b""))).withColumns({"filename": safe_filename(F.col("filename")), "size_bytes": F.length("content").cast("long")})
    reason = reject_reason(F.col("filename"), F.col("size_bytes"), F.substring("content", 1, 1024), most_bytes)
    return files.withColumn("error", F.coalesce("read_error", reason) if "read_error" in files.columns else reason)


def validate_uploads(files: DataFrame, most_bytes: int = MOST_BYTES, folder: str = "uploads") -> DataFrame:
    """files (position, filename, content; null counts as empty) with their safe name, size, reject reason, and for accepted ones hash and path; and read_error, if files have it."""
    rows = _judged(files, most_bytes)
    sha = F.when(F.col("error").isNull(), F.sha2("content", 256))
    more = ["read_error"] if "read_error" in files.columns else []
    return rows.select("position", "filename", "size_bytes", "error", sha.alias("sha256"), F.concat(F.lit(f"{folder}/"), sha, F.lit(".pdf")).alias("source_path"), *more)


def stored_contents(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """sha256 and content of accepted files, one row for a content."""
    return _judged(files, most_bytes).where("error is null").select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])


def upload_bytes(uploads: DataFrame) -> DataFrame:
    """One row: submitted_bytes and accepted_bytes of uploads (size_bytes, error), 0 for none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return uploads.agg(total(F.col("size_bytes")).alias("submitted_bytes"), total(F.when(F.col("error").isNull(), F.col("size_bytes"))).alias("accepted_bytes"))


def register_documents(documents: DataFrame, uploads: DataFrame, force: bool = False) -> DataFrame:
    """The documents after uploads (position, filename, sha256, source_path), with inserted and queued flags.

    A known content takes the newest name. It is queued if it is new, has failed before or, with force, is done.
    A new id is the highest one before plus one and the place of the first upload, so that nothing has to be numbered in one task.
    """
    incoming = uploads.where("sha256 is not null").groupBy("sha256").agg(
        F.max_by("filename", "position").alias("new_name"), F.max_by("source_path", "position").alias("new_path"), F.min("position").alias("first")
    )
    known = documents.select("sha256", "id", "filename", "source_path", "status", "error").join(incoming, "sha256", "full_outer")
    inserted, touched = F.col("id").isNull(), F.col("first").isNotNull()
    again = F.col("status").isin("uploaded", "failed", "partial") | (F.lit(force) & (F.col("status") == "done"))
    queued = touched & (inserted | F.coalesce(again, F.lit(False)))
    highest = documents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.select(
        F.coalesce("id", F.col("first").cast("long") + (highest + 1)).alias("id"), "sha256", F.coalesce("new_name", "filename").alias("filename"), F.coalesce("new_path", "source_path").alias("source_path"),
        F.when(queued, "queued").otherwise(F.col("status")).alias("status"), F.when(~queued, F.col("error")).alias("error"), (inserted & touched).alias("inserted"), queued.alias("queued"),
    )


def add_memberships(memberships: DataFrame, added: DataFrame) -> DataFrame:
    """memberships with those of added (knowledge_base_id, document_id, added_via_batch_id) that are new; the first batch keeps the credit."""
    keys = ["knowledge_base_id", "document_id"]
    first = added.groupBy(*keys).agg(F.min("added_via_batch_id").alias("added_via_batch_id"))
    return memberships.unionByName(first.join(memberships.select(*keys), keys, "left_anti"))


def enrol_all(memberships: DataFrame, documents: DataFrame, knowledge_base_id: int) -> DataFrame:
    """Every document becomes a member of the knowledge base."""
    k = F.lit(knowledge_base_id).cast("long").alias("knowledge_base_id")
    return add_memberships(memberships, documents.select(k, F.col("id").alias("document_id"), F.lit(None).cast("long").alias("added_via_batch_id")))


def batch_items(uploads: DataFrame, documents: DataFrame, batch_id: int) -> DataFrame:
    """One item for each upload; a bad file is rejected, one that could not be read has failed, and neither stops anything."""
    bad = F.when(F.col("read_error").isNotNull(), "failed").otherwise("rejected") if "read_error" in uploads.columns else F.lit("rejected")
    docs = documents.select("sha256", F.col("id").alias("document_id"), F.col("status").alias("s"))
    rows = uploads.join(docs, "sha256", "left")
    return rows.select(F.lit(batch_id).cast("long").alias("batch_id"), "position", "filename", "document_id", "sha256", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("s")).alias("status"), "error")


def create_knowledge_base(bases: DataFrame, name: str, description: str | None = None) -> DataFrame:
    """bases with one more; its slug is derived from its name and place."""
    name, description = (name or "").strip(), (description or "").strip() or None
    if not 1 <= len(name) <= 200 or len(description or "") > 2000:
        raise ValueError("a name of 1 to 200 characters and a description of at most 2000 are needed")
    top = bases.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).select((F.col("id") + 1).alias("id"))
    slug = F.concat(F.lit("kb-"), F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(name)), 256), 1, 12))
    row = top.select("id", slug.alias("slug"), F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.current_timestamp().alias("created_at"))
    return bases.unionByName(row)


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """A document that was parsed again has its new chunks only."""
    return replace_rows(chunks, fresh, "document_id")


def create_batch(batches: DataFrame, knowledge_base_id: int, name: str | None = None) -> tuple[DataFrame, int]:
    """batches with one more, and its id; a name is trimmed and cut to 200 characters, and null if blank."""
    id_ = batches.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    name = (name or "").strip()[:200] or None
    row = batches.sparkSession.range(1).select(F.lit(id_).cast("long").alias("id"), F.lit(knowledge_base_id).cast("long").alias("knowledge_base_id"), F.lit(name).cast("string").alias("name"), F.current_timestamp().alias("created_at"))
    return batches.unionByName(row, allowMissingColumns=True), id_


def ingest_batch(t: Tables, files: DataFrame, knowledge_base_id: int, name: str | None = None, force: bool = False, most_bytes: int = MOST_BYTES, most_files: int = BOUNDS["files"][1]) -> tuple[Tables, int, DataFrame]:
    """(tables, batch id, metadata (position, size_bytes, was_new_document, queued_for_processing)) after files (position, filename, content).

    Every file has an item; a rejected one says why and stops nothing. Accepted ones are registered, become members and are queued once."""
    if t.knowledge_bases.where(F.col("id") == knowledge_base_id).isEmpty():
        raise KeyError("knowledge base not found")
    if not 1 <= (n := files.count()) <= most_files:
        raise ValueError(f"a batch has from 1 to {most_files} files, not {n}")
    uploads = cut(validate_uploads(files, most_bytes))
    batches, batch = create_batch(t.batches, knowledge_base_id, name)
    registered = cut(register_documents(t.documents, uploads, force))
    accepted = uploads.where("error is null").select("sha256").distinct()
    added = registered.join(accepted, "sha256", "left_semi").select(F.lit(knowledge_base_id).cast("long").alias("knowledge_base_id"), F.col("id").alias("document_id"), F.lit(batch).cast("long").alias("added_via_batch_id"))
    items = batch_items(uploads, registered, batch)
    flags = uploads.select("position", "size_bytes", "sha256").join(registered.select("sha256", "inserted", "queued"), "sha256", "left")
    no = F.lit(False)
    metadata = flags.select("position", "size_bytes", F.coalesce("inserted", no).alias("was_new_document"), F.coalesce("queued", no).alias("queued_for_processing"))
    now = t.with_(documents=registered, batches=batches, memberships=add_memberships(t.memberships, added), batch_items=t.batch_items.unionByName(items, allowMissingColumns=True))
    return now, batch, metadata


def ingest_document(t: Tables, filename: str, content: bytes, most_bytes: int = MOST_BYTES) -> tuple[Tables, DataFrame]:
    """(tables, its item) after one file into the default knowledge base, the one with the least id; a rejected file raises."""
    default = t.knowledge_bases.agg(F.min("id")).first()[0]
    if default is None:
        raise KeyError("there is no knowledge base")
    files = t.knowledge_bases.sparkSession.createDataFrame([(0, filename, bytearray(content or b""))], "position long, filename string, content binary")
    now, batch, metadata = ingest_batch(t, files, default, most_bytes=most_bytes)
    item = now.batch_items.where(F.col("batch_id") == batch).join(metadata, "position")
    if (error := item.first().error) is not None:
        raise ValueError(error)
    return now, item
