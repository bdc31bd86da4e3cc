"""The application store: reads, set-based changes and audit rows over immutable tables.

A change returns the table as it is afterwards; publish it with plans.index.publish().
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..functions.records import redacted


def history(chats: DataFrame, messages: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Each chat with its messages in order, each message with its sources in order; both may be empty."""
    if sources is not None:
        s = sources.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("source_number", "source_name", "pages", "similarity"))).alias("sources"))
        messages = messages.join(s, messages.id == s.message_id, "left").drop("message_id")
    fields = [c for c in messages.columns if c not in ("chat_id", "created_at", "id")]
    m = messages.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", *fields))).alias("messages"))
    return chats.join(m, chats.id == m.chat_id, "left").drop("chat_id")


def owned(chats: DataFrame, user_id: Column | str) -> DataFrame:
    """A user's chats that aren't deleted, the latest first."""
    return chats.where((F.col("user_id") == user_id) & F.col("deleted_at").isNull()).orderBy(F.desc("updated_at"), "id")


def lockouts(attempts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """user_id, ts, failures in a row and locked_until after each failed attempt.

    attempts: user_id, ts, event_id, success. A success resets the count; the end of a lock doesn't, so the
    next failure locks again at once.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = attempts.withColumn("run", F.sum(F.col("success").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.sum((~F.col("success")).cast("int")).over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    out = run.withColumn("failures", count).where(~F.col("success"))
    return out.withColumn("locked_until", F.when(F.col("failures") >= config.lock_after, F.col("ts") + F.expr(f"interval {config.lock_minutes} minutes"))).drop("run", "success")


def sessions_state(sessions: DataFrame, as_of: datetime | Column) -> DataFrame:
    """sessions with is_expired, is_revoked and is_valid at a time."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    out = sessions.withColumns({"is_expired": F.col("expires_at") <= now, "is_revoked": F.col("revoked_at").isNotNull()})
    return out.withColumn("is_valid", ~F.col("is_expired") & ~F.col("is_revoked"))


def authenticated(tokens: DataFrame, sessions: DataFrame, users: DataFrame, as_of: datetime | Column) -> DataFrame:
    """token and user of the tokens whose sessions are valid and whose users are active; sessions keep token hashes only."""
    s = sessions_state(sessions, as_of).where("is_valid").select("token_hash", "user_id", F.col("id").alias("session_id"))
    u = users.where("is_active").select(F.col("id").alias("user_id"), "role", "must_change_password")
    return tokens.withColumn("token_hash", F.sha2("token", 256)).join(s, "token_hash").join(u, "user_id").drop("token_hash")


def guarded(requests: DataFrame, sessions: DataFrame, users: DataFrame, as_of: datetime | Column) -> DataFrame:
    """requests (token, area) with user_id and `refused`: why a request is refused, null where it is let in.

    area: "login" asks for a valid session of an active user, "user" for a changed password too, "admin" for the role as well.
    """
    valid = authenticated(requests.select("token").where("token is not null").distinct(), sessions, users, as_of)
    rows = requests.join(valid.drop("session_id"), "token", "left")
    why = (
        F.when(F.coalesce("token", F.lit("")) == "", "not_authenticated")
        .when(F.col("user_id").isNull(), "invalid_session")
        .when((F.col("area") != "login") & F.col("must_change_password"), "password_change_required")
        .when((F.col("area") == "admin") & (F.coalesce("role", F.lit("")) != "admin"), "not_admin")
    )
    return rows.select(*requests.columns, "user_id", why.alias("refused"))


def patched(users: DataFrame, patches: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """users after partial updates, and the patches with `refused`: null where applied.

    patches: admin_id, id, name, email, role, is_active; null leaves a field as it is, one patch a user. Refused are patches
    of unknown users, an email that another user has or another patch asks for, and admins who would lose their own role or account.
    """
    email = F.lower(F.trim("email"))
    asked = patches.withColumn("email", email)
    taken = users.select(F.col("id").alias("_owner"), F.lower("email").alias("email"))
    owner = asked.join(taken, "email").where("_owner <> id").select("id").distinct().withColumn("_taken", F.lit(True))
    twice = F.count("email").over(Window.partitionBy("email")) > 1
    rows = asked.join(users.select("id", F.lit(True).alias("_known")), "id", "left").join(owner, "id", "left").withColumn("_twice", F.col("email").isNotNull() & twice)
    own = F.col("id") == F.col("admin_id")
    why = (
        F.when(F.col("_known").isNull(), "unknown_user")
        .when(F.coalesce("_taken", "_twice"), "email_taken")
        .when(own & (F.col("role") != "admin"), "own_role")
        .when(own & ~F.col("is_active"), "own_account")
    )
    judged = rows.withColumn("refused", why).select(*patches.columns, "refused")
    fields = ["name", "email", "role", "is_active"]
    fine = judged.where("refused is null").select("id", F.trim("name").alias("_name"), F.col("email").alias("_email"), F.col("role").alias("_role"), F.col("is_active").alias("_is_active"), F.lit(True).alias("_patched"))
    out = users.join(fine, "id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields} | {"updated_at": F.when(F.col("_patched"), as_of).otherwise(F.col("updated_at"))})
    return out.select(users.columns), judged


def logins(attempts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """attempts with `outcome`, failures and locked_until after each: the whole login machine.

    attempts: user_id, ts, event_id, known, is_active, password_ok. Outcomes in order of the tests: invalid_credentials (no such
    user), inactive_user, temporary_lock, invalid_credentials (a wrong password, which counts), login_success. A locked
    attempt isn't counted, and a success resets the count; after a lock the next failure locks again at once. Which
    attempts count depends on those before, so a user's attempts are folded in order.
    """
    minutes, kind = F.expr(f"interval {config.lock_minutes} minutes"), attempts.schema["ts"].dataType.simpleString()
    every = F.sort_array(F.collect_list(F.struct("ts", "event_id", "known", "is_active", "password_ok")))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast(kind).alias("until"), F.array().cast(f"array<struct<event_id:bigint,outcome:string,failures:int,locked_until:{kind}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        what = F.when(~x.known, "invalid_credentials").when(~x.is_active, "inactive_user").when(F.coalesce(s.until > x.ts, F.lit(False)), "temporary_lock").when(~x.password_ok, "wrong_password").otherwise("login_success")

        def after(w: Column) -> Column:
            n = F.when(w == "wrong_password", s.n + 1).when(w == "login_success", 0).otherwise(s.n)
            until = F.when((w == "wrong_password") & (s.n + 1 >= config.lock_after), x.ts + minutes).when(w == "login_success", F.lit(None)).otherwise(s.until)
            shown = F.when(w == "wrong_password", "invalid_credentials").otherwise(w)
            return F.struct(n.alias("n"), until.alias("until"), F.concat(s.out, F.array(F.struct(x.event_id.cast("bigint").alias("event_id"), shown.alias("outcome"), n.alias("failures"), until.alias("locked_until")))).alias("out"))

        return T.let(what, after)

    return attempts.groupBy("user_id").agg(every.alias("e")).select("user_id", F.explode(F.aggregate("e", start, step, lambda s: s.out)).alias("r")).select("user_id", "r.*")


def changed(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """table with new values where the condition holds: a bulk or partial update, or a soft delete."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def revoked(sessions: DataFrame, users: Column, as_of: Column) -> DataFrame:
    return changed(sessions, users & F.col("revoked_at").isNull(), revoked_at=as_of)


def soft_deleted(chats: DataFrame, which: Column, as_of: Column) -> DataFrame:
    return changed(chats, which & F.col("deleted_at").isNull(), deleted_at=as_of, updated_at=as_of)


def appended(table: DataFrame, rows: DataFrame, *, unique: str | None = None) -> tuple[DataFrame, DataFrame]:
    """table with rows added, and the rows refused because their unique key is there already."""
    if unique is None:
        return table.unionByName(rows), rows.limit(0)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(unique).orderBy("id"))).join(table.select(unique, F.lit(True).alias("_there")), unique, "left")
    fresh = F.col("_there").isNull() & (F.col("_n") == 1)
    return table.unionByName(first.where(fresh).select(table.columns)), first.where(~fresh).select(rows.columns)


def audited(log: DataFrame, rows: DataFrame) -> DataFrame:
    """An audit log with rows added, their metadata always redacted."""
    return log.unionByName(rows.withColumn("metadata_json", redacted(F.col("metadata_json"))))


def latest(versions: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest version of each row of an append-only table."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def cascade(children: DataFrame, parents: DataFrame, foreign: str, *, set_null: bool = False) -> DataFrame:
    """children whose parents are still there; with set_null all of them, without the reference to a parent that is gone."""
    ids = parents.select(F.col("id").alias(foreign))
    if not set_null:
        return children.join(ids, foreign, "left_semi").unionByName(children.where(F.col(foreign).isNull()))
    out = children.join(ids.withColumn("_there", F.lit(True)), foreign, "left")
    return out.withColumn(foreign, F.when(F.col("_there"), F.col(foreign))).drop("_there").select(children.columns)


def titled(questions: DataFrame, column: str = "text") -> DataFrame:
    return questions.withColumns({"title": T.chat_title(F.col(column)), "given_title": T.clean_title(F.col(column))})


def answer_lines(answers: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """key, line_no, section, kind, line: the parts of Markdown answers (### sections, - bullets, texts)."""
    rows = answers.select(*key, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "raw")).withColumn("line", T.strip(F.col("raw"))).where("line <> ''")
    heading = F.col("line").startswith("### ")
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(heading, "section").when(F.col("line").startswith("- "), "bullet").otherwise("text")
    return rows.select(*key, "line_no", F.sum(heading.cast("int")).over(w).cast("int").alias("section"), kind.alias("kind"), F.regexp_replace("line", "^(### |- )", "").alias("line"))
