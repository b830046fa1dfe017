"""State transitions as pure functions: state and as_of in, new state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions.scalars import can_retry, idempotency_key
from docketspark.functions.validation import clean_name, clean_note, in_range, name_error, note_error
from docketspark.operators.ingest import enqueue, uuid_of

TTL_SECONDS, IDLE_LEAST = (60, 604_800), 60
LEASE_LOST = "attempt limit reached after an interrupted run"  # fixed value


def seconds(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def insert_partners(requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(new partners, rejected requests with error_code); requests: request_id, bureau_id, name, note."""
    error = F.coalesce(name_error(F.col("name")), note_error(F.col("note")))
    checked = requests.withColumn("error_code", error)
    new = checked.where("error_code is null").select(
        uuid_of(F.col("bureau_id"), F.col("request_id")).alias("id"), "bureau_id", clean_name(F.col("name")).alias("name"), clean_note(F.col("note")).alias("note"), as_of.alias("created_at"), as_of.alias("updated_at")
    )
    return new, checked.where("error_code is not null")


def patched(name: Column, note: Column, new_name: Column, has_note: Column, new_note: Column) -> tuple[Column, Column]:
    """A null name keeps the old one; the note changes only if the patch has one, be it null."""
    return F.coalesce(new_name, name), F.when(has_note, new_note).otherwise(note)


def patch_partners(partners: DataFrame, patches: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(partners after the patches, rejected patches). patches: id, bureau_id, name, has_note, note; one an id.

    A patch without any change and a bad value are rejected; a patch of an unknown partner changes nothing.
    """
    error = F.when(F.col("name").isNull() & ~F.col("has_note"), F.lit("validation_failed"))
    error = F.coalesce(error, F.when(F.col("name").isNotNull(), name_error(F.col("name"))), F.when(F.col("has_note"), note_error(F.col("note"))))
    checked = patches.withColumn("error_code", error)
    good = checked.where("error_code is null").select("bureau_id", "id", clean_name(F.col("name")).alias("_n"), F.col("has_note").alias("_h"), clean_note(F.col("note")).alias("_t"))
    joined = partners.join(good, ["bureau_id", "id"], "left")
    name, note = patched(F.col("name"), F.col("note"), F.col("_n"), F.coalesce("_h", F.lit(False)), F.col("_t"))
    hit = F.col("_h").isNotNull()
    out = joined.withColumns({"name": name, "note": note, "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))})
    return out.select(*partners.columns), checked.where("error_code is not null")


def more_attempts(attempts: Column, most: Column) -> Column:
    return F.greatest(most, attempts + 1)


def retry_materials(materials: DataFrame, jobs: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(materials, jobs, refused) after retries. requests: bureau_id, partner_id, material_id.

    Failed and partial materials are queued again and their job with them: attempts stay, the limit allows one
    more, stage, error and lease are cleared; a material without a job gets one. Others are refused (409).
    """
    wanted = requests.distinct().select("bureau_id", "partner_id", F.col("material_id").alias("id"))
    hit = materials.join(wanted, ["bureau_id", "partner_id", "id"], "left_semi")
    refused = hit.where(~can_retry(F.col("status"))).select("id", "status")
    again = hit.where(can_retry(F.col("status"))).select("bureau_id", "id", F.lit(True).alias("_again"))
    none = F.lit(None).cast("string")
    on = F.col("_again").isNotNull()
    m = materials.join(again, ["bureau_id", "id"], "left")
    m = m.withColumns({"status": F.when(on, "queued").otherwise(F.col("status")), "error": F.when(on, none).otherwise(F.col("error")), "updated_at": F.when(on, as_of).otherwise(F.col("updated_at"))}).select(*materials.columns)
    keys = again.select("bureau_id", idempotency_key(F.lit("extract_document"), F.col("id")).alias("idempotency_key"), "_again")
    j = jobs.join(keys, ["bureau_id", "idempotency_key"], "left")
    changes = {"status": F.lit("queued"), "stage": none, "error": none, "run_after": as_of, "lease_owner": none, "lease_expires_at": F.lit(None).cast("timestamp"), "max_attempts": more_attempts(F.col("attempts"), F.col("max_attempts")), "updated_at": as_of}
    j = j.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*jobs.columns)
    return m, j.unionByName(enqueue(m.join(again, ["bureau_id", "id"], "left_semi"), jobs).select(*jobs.columns)), refused


def reclaim_expired_leases(jobs: DataFrame, bureau_id: str | None, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs after it, one row: reclaimed). Running jobs whose lease has run out are queued, or failed at their limit.

    A running job without a lease is never reclaimed, and materials keep their status.
    """
    mine = F.col("id").isNotNull() if bureau_id is None else F.col("bureau_id") == bureau_id
    lost = F.coalesce(F.lit(bool(bureau_id)) & mine & (F.col("status") == "running") & (F.col("lease_expires_at") < as_of), F.lit(False))
    done = F.col("attempts") >= F.col("max_attempts")
    changes = {
        "status": F.when(done, "failed").otherwise("queued"),
        "error": F.when(done, LEASE_LOST).otherwise(F.col("error")),
        "lease_owner": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
        "run_after": as_of,
        "updated_at": as_of,
    }
    after = jobs.withColumn("_lost", lost).withColumns({c: F.when(F.col("_lost"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_lost")
    return after, jobs.agg(F.count_if(lost).alias("reclaimed"))


def provision(bureaus: DataFrame, slug: str, name: str, as_of: Column) -> DataFrame:
    """One row, id: the bureau already there under the slug, else the one to insert."""
    new = bureaus.sparkSession.range(1).select(uuid_of(F.lit("bureau"), F.lit(slug)).alias("id"), F.lit(1).alias("rank"))
    old = bureaus.where(F.col("slug") == slug).select("id", F.lit(0).alias("rank"))
    return old.unionByName(new).orderBy("rank").limit(1).select("id")


# --- sessions ---------------------------------------------------------------------------------------------------


def open_sessions(requests: DataFrame, bureaus: DataFrame, ttl_seconds: int, as_of: Column) -> DataFrame:
    """New sessions of requests (slug, token_fingerprint, csrf_token); an unknown slug fails the batch."""
    in_range(ttl_seconds, *TTL_SECONDS, "session ttl")
    known = requests.join(bureaus.select("slug", F.col("id").alias("bureau_id")), "slug", "left")
    bureau = F.when(F.col("bureau_id").isNotNull(), F.col("bureau_id")).otherwise(F.raise_error(F.concat(F.lit("bureau is not provisioned: "), F.col("slug"))))
    return known.select(
        uuid_of(F.lit("session"), F.col("token_fingerprint")).alias("id"), bureau.alias("bureau_id"), "token_fingerprint", "csrf_token", as_of.alias("created_at"), as_of.alias("last_seen_at"), (as_of + seconds(ttl_seconds)).alias("expires_at")
    )


def is_live(idle_seconds: int, as_of: Column) -> Column:
    in_range(idle_seconds, IDLE_LEAST, None, "idle timeout")
    return (F.col("expires_at") > as_of) & (F.col("last_seen_at") > as_of - seconds(idle_seconds))


def touch_sessions(sessions: DataFrame, fingerprints: list[str], idle_seconds: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions after it, the touched ones): live sessions are seen now, others yield no row."""
    hit = F.col("token_fingerprint").isin(fingerprints) & is_live(idle_seconds, as_of)
    after = sessions.withColumn("last_seen_at", F.when(hit, as_of).otherwise(F.col("last_seen_at")))
    return after, sessions.where(hit).select(F.col("id").alias("session_id"), "bureau_id", "csrf_token", "expires_at")


def close_session(sessions: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    hit = F.col("token_fingerprint") == fingerprint
    return sessions.where(~hit), sessions.agg(F.count_if(hit).alias("removed"))


def purge_sessions(sessions: DataFrame, idle_seconds: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(live sessions, one row: purged). Purged are exactly the sessions that aren't live."""
    live = is_live(idle_seconds, as_of)
    return sessions.where(live), sessions.agg(F.count_if(~live).alias("purged"))


def upsert_list(shown: DataFrame, incoming: DataFrame, partner_id: str) -> DataFrame:
    """A client's list after incoming items: known ids keep their position, new ones come first, other partners' are ignored.

    shown: id, partner_id, position and more columns; incoming: the same without position.
    """
    new = incoming.where(F.col("partner_id") == partner_id)
    old = shown.alias("o").join(new.alias("n"), "id", "full_outer")
    rest = [c for c in shown.columns if c not in ("id", "position")]
    there = F.col("n.partner_id").isNotNull()
    return old.select("id", *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], F.coalesce(F.col("o.position"), F.lit(-1)).alias("position"))


