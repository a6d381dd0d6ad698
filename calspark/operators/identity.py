"""Accounts that link a person's users on two platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .saved import saved


def subject(account: str = "account_id") -> Column:
    """The account if there is one, else the platform's user."""
    return F.coalesce(F.concat(F.lit("account:"), F.col(account).cast("string")), F.concat_ws(":", "platform", F.col("external_id").cast("string")))


def resolved(users: DataFrame, identities: DataFrame) -> DataFrame:
    """Users with the account they are linked to, if any, and their subject."""
    links = identities.select("platform", "external_id", "account_id")
    return users.join(links, ["platform", "external_id"], "left").withColumn("subject", subject())


def linked(events: DataFrame, users: DataFrame, identities: DataFrame) -> DataFrame:
    """Events with the subject of their user."""
    return events.join(resolved(users, identities).select("user_id", "subject"), "user_id")


def first_identity(identities: DataFrame, preferred: str | None = None) -> DataFrame:
    """The identity of each account on the preferred platform or, without one, that of the smallest external id."""
    order = F.struct((F.col("platform") != F.lit(preferred) if preferred else F.lit(False)).alias("other"), "external_id", "platform")
    best = identities.groupBy("account_id").agg(F.min(order).alias("x"))
    return best.select("account_id", "x.platform", "x.external_id")


def judged_moves(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """Requests to move account_id into new_account_id, with a reject: same where there is nothing to do, platform where
    both have an identity on one platform; null where the move may be made."""
    own = identities.select("account_id", "platform").distinct()
    theirs = own.withColumnRenamed("account_id", "new_account_id")
    clash = requests.select("account_id", "new_account_id").distinct().join(own, "account_id").join(theirs, ["new_account_id", "platform"], "left_semi")
    clash = clash.select("account_id", "new_account_id", F.lit(True).alias("clash")).distinct()
    reject = F.when(F.col("account_id") == F.col("new_account_id"), "same").when(F.col("clash"), "platform")
    return requests.join(clash, ["account_id", "new_account_id"], "left").withColumn("reject", reject).drop("clash")


def merged_in_order(requests: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (request_no, account_id, new_account_id) judged one after the other, and where each account ends (account_id, root).

    reject is same, platform or null, as in ``judged_moves``, but of the accounts as earlier requests have left them: what was moved
    into an account counts as its own, and a request for a moved account is one for where it is. In each round all requests
    are judged that no earlier open one touches, so rounds are as many as the longest chain of requests, not as there are requests.
    """
    open_ = requests.select("request_no", "account_id", "new_account_id")
    accounts = open_.select("account_id").unionByName(open_.select(F.col("new_account_id").alias("account_id"))).distinct()
    roots, open_, judged = saved(accounts.withColumn("root", F.col("account_id"))), saved(open_), []
    own = saved(identities.select("account_id", "platform").distinct().join(accounts, "account_id", "left_semi"))
    while not open_.isEmpty():
        at = lambda c, name: roots.select(F.col("account_id").alias(c), F.col("root").alias(name))  # noqa: B023, E731
        now = open_.join(at("account_id", "from_root"), "account_id").join(at("new_account_id", "to_root"), "new_account_id")
        touched = now.select("request_no", F.explode(F.array("from_root", "to_root")).alias("root")).groupBy("root").agg(F.min("request_no").alias("first"))
        first = lambda c: touched.select(F.col("root").alias(c), F.col("first").alias(f"first_{c}"))  # noqa: B023, E731
        ready = now.join(first("from_root"), "from_root").join(first("to_root"), "to_root").filter("request_no = first_from_root AND request_no = first_to_root")
        platforms = own.join(roots, "account_id").groupBy("root").agg(F.collect_set("platform").alias("p"))
        with_p = lambda df, c: df.join(platforms.select(F.col("root").alias(c), F.col("p").alias(f"p_{c}")), c, "left")  # noqa: B023, E731
        ready = with_p(with_p(ready, "from_root"), "to_root")
        reject = F.when(F.col("from_root") == F.col("to_root"), "same").when(F.coalesce(F.arrays_overlap("p_from_root", "p_to_root"), F.lit(False)), "platform")
        ready = saved(ready.select("request_no", "account_id", "new_account_id", "from_root", "to_root", reject.alias("reject")))
        judged.append(ready)
        moved = ready.filter("reject IS NULL").select(F.col("from_root").alias("root"), "to_root")
        roots = saved(roots.join(moved, "root", "left").select("account_id", F.coalesce("to_root", "root").alias("root")))
        open_ = saved(open_.join(ready.select("request_no"), "request_no", "left_anti"))
    out = requests.select("request_no", "account_id", "new_account_id").limit(0).withColumn("reject", F.lit(None).cast("string"))
    for ready in judged:
        out = out.unionByName(ready.select(*out.columns))
    return out, roots


def merged(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows with account_id replaced where ``moves`` (account_id, new_account_id) says so: identities, series, drafts, turns, delivery states."""
    return rows.join(moves, "account_id", "left").withColumn("account_id", F.coalesce("new_account_id", "account_id")).drop("new_account_id").select(*rows.columns)


def merged_preferences(preferences: DataFrame, moves: DataFrame) -> DataFrame:
    """Preferences after the moves: an account without its own takes those of the least account that moves into it."""
    rest = [c for c in preferences.columns if c != "account_id"]
    moved = preferences.join(moves, "account_id").groupBy("new_account_id").agg(F.min_by(F.struct(*rest), "account_id").alias("p"))
    taken = moved.select(F.col("new_account_id").alias("account_id"), "p.*").join(preferences.select("account_id"), "account_id", "left_anti")
    return preferences.unionByName(taken)
