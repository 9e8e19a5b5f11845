"""Alias learning: which item a supplier's code means, from what buyers have confirmed or rejected.

Votes are summed by provider, code and item, and sums of new confirmations are merged into those kept, so a round reads its own rows
alone.  Each confirmation has an id, and rounds are numbered; a round that was merged is not merged again.  Of a code's items the one with the
most net votes is its alias, unless a rival has too many, or it was rejected last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store, Transaction, stable_id

#: Net votes that an alias needs, and the share of all votes for a code that it must have.
LEAST_VOTES, MAJORITY = 1, 2 / 3
_KEY = ["provider_id", "supplier_code", "item_id"]


def votes(confirmations: DataFrame) -> DataFrame:
    """provider_id, supplier_code, item_id, yes, no, first_yes, last_yes, last_no of confirmations (confirmation_id, those, accepted, confirmed_at); repeated ids count once."""
    once = confirmations.where(F.col("supplier_code").isNotNull() & F.col("item_id").isNotNull()).groupBy("confirmation_id").agg(F.max(F.struct("confirmed_at", *_KEY, "accepted")).alias("_c")).select("_c.*")
    yes, no = F.when(F.col("accepted"), F.col("confirmed_at")), F.when(~F.col("accepted"), F.col("confirmed_at"))
    return once.groupBy(*_KEY).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"), F.min(yes).alias("first_yes"), F.max(yes).alias("last_yes"), F.max(no).alias("last_no"))


def merged_votes(kept: DataFrame, new: DataFrame) -> DataFrame:
    """The sums of both."""
    how = {"yes": F.sum, "no": F.sum, "first_yes": F.min, "last_yes": F.max, "last_no": F.max}
    return kept.unionByName(new).groupBy(*_KEY).agg(*[f(c).alias(c) for c, f in how.items()])


def decided(sums: DataFrame) -> DataFrame:
    """provider_id, supplier_code, item_id, votes, share, since, contradicted: each code's best item; ties go to the later yes, then the first id.

    `contradicted`: it lacks the majority or the votes, or its last no is not before its last yes.  Such a code has no alias.
    """
    code = Window.partitionBy("provider_id", "supplier_code")
    net = F.greatest(F.col("yes") - F.col("no"), F.lit(0))
    ranked = sums.withColumn("votes", net).withColumn("_all", F.sum("votes").over(code))
    ranked = ranked.withColumn("_place", F.row_number().over(code.orderBy(F.desc("votes"), F.desc_nulls_last("last_yes"), "item_id"))).where("_place = 1")
    share = F.when(F.col("_all") > 0, F.col("votes") / F.col("_all")).otherwise(0.0)
    against = F.coalesce(F.col("last_no") >= F.col("last_yes"), F.lit(False))
    return ranked.select("provider_id", "supplier_code", "item_id", "votes", share.alias("share"), F.col("first_yes").alias("since"), ((F.col("votes") < LEAST_VOTES) | (share < MAJORITY) | against).alias("contradicted"))


def learn(store: Store, confirmations: DataFrame, round_no: int) -> int:
    """Merges a round of confirmations and rewrites the aliases of the codes in it; in one commit, once for each number.

    An alias is confirmed since the first yes for its item, in whatever order rounds come; a code that is contradicted loses its alias.  Gives the number of the commit.
    """
    name = f"aliases-{round_no:08d}"

    def work(tx: Transaction) -> None:
        if name in tx.state.migrations:
            return
        new = votes(confirmations)
        touched = store.staged("alias_votes", new)
        before = tx.read("alias_votes", touched[1])
        sums = merged_votes(before, touched[0])
        codes = touched[0].select("provider_id", "supplier_code").distinct()
        found = decided(sums.join(codes, ["provider_id", "supplier_code"], "left_semi"))
        old = tx.read("supplier_item_aliases", touched[1])
        kept = old.join(codes, ["provider_id", "supplier_code"], "left_anti")
        fresh = found.where("NOT contradicted").select(stable_id("provider_id", "supplier_code").alias("id"), "provider_id", "supplier_code", "item_id", F.col("since").alias("confirmed_at"))
        tx.rewrite("supplier_item_aliases", touched[1], kept.unionByName(fresh))
        tx.rewrite("alias_votes", touched[1], sums)
        tx.migrations[name] = "learnt"

    return store.transact(work)
