"""A positional index of texts: substring search by a join on terms instead of a scan of all texts.

A text is words and what stands between them, in small letters. The index has a row for each word of each text, with its place, the gaps before and after it and the word that follows; the vocabulary has each word
once. A query is cut in the same way. Its inner words must be words of the text; where no gap of the query bounds them, the first may be the end of a word, the last the beginning of one, and a
word alone a part of one. The vocabulary tells which words these are, which is a join of few rows, and the index where they stand. What is in the text at the right distances, with the query's gaps between, is a match: the same rows as those whose
text contains the query.

Defined results: a null or empty text has no words, and is found by the empty query only if it is not null; a query without words is looked for in the gaps; ids may repeat and are given once; an empty index gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a word is made of.
WORD = r"[\p{L}\p{N}_]+"
#: Words of a vocabulary that fit a query; up to so many are sent to all tasks.
SENT_ROWS = 100_000


def indexed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, pos, term, before, after, next, beyond) of every word: the gaps on both sides of it, the word that follows and the gap behind that one; a text without words has one row without a term, and its gap."""
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(text).alias("low"))
    # as columns, so that a text is cut once and not once a word
    rows = rows.select("id", "low", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"), F.split("low", WORD, -1).alias("gaps"))
    n = F.size("words")
    from_ = lambda x, at: F.slice(x, F.lit(at), n)
    each = F.arrays_zip(F.col("words").alias("term"), from_("gaps", 1).alias("before"), from_("gaps", 2).alias("after"), from_("words", 2).alias("next"), from_("gaps", 3).alias("beyond"))
    none = F.lit(None).cast("string")
    bare = F.array(F.struct(none.alias("term"), F.col("low").alias("before"), F.lit("").alias("after"), none.alias("next"), none.alias("beyond")))
    return rows.select("id", F.posexplode(F.when(n > 0, each).otherwise(bare)).alias("pos", "w")).select("id", "pos", "w.*")


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, n): every word and how often it occurs."""
    return index.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def cut_query(query: str) -> tuple[list[str], list[str]]:
    """Words of a query, and the gaps before, between and behind them."""
    low = query.lower()
    return re.findall(r"[^\W]+", low), re.split(r"[^\W]+", low)


def matches(index: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """(id) of the texts that contain ``query``, in any case; ``terms`` is the index's vocabulary."""
    words, gaps = cut_query(query)
    if not words:
        return index.filter(F.contains("before", F.lit(gaps[0])) | F.contains("after", F.lit(gaps[0]))).select("id").distinct()
    last = len(words) - 1

    def fits(term: str, i: int) -> Column:
        # open on a side where the query has no gap there
        left, right, t, w = i == 0 and gaps[0] == "", i == last and gaps[-1] == "", F.col(term), words[i]
        return F.contains(t, F.lit(w)) if left and right else t.endswith(w) if left else t.startswith(w) if right else t == w

    # the gap in front of the first word ends with the query's, that behind the last begins with it, those between are the query's
    behind = lambda gap, i: F.col(gap).startswith(gaps[-1]) if i == last else F.col(gap) == gaps[i + 1]
    # a row tells of a word and the next, so all words but the last are looked for, and one or two need no counting
    sought = range(max(last, 1))
    which = F.filter(F.array(*(F.when(fits("term", i), F.lit(i)) for i in sought)), lambda x: x.isNotNull())
    wanted = terms.select("term", F.explode(which).alias("i"))
    wanted = F.broadcast(wanted) if wanted.limit(SENT_ROWS + 1).count() <= SENT_ROWS else wanted
    here = lambda i: [behind("after", i), *([F.col("before").endswith(gaps[0])] if i == 0 else []), *([fits("next", i + 1), behind("beyond", i + 1)] if last else [])]
    there = reduce(or_, (reduce(and_, here(i), F.col("i") == i) for i in sought))
    found = index.join(wanted, "term").filter(there)
    if last > 1:
        found = found.groupBy("id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == last)
    return found.select("id").distinct()
