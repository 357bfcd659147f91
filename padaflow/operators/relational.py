"""The exploded layout: tokens, keys, postings and matches as tables, for analysis and large lexicons.

A lexicon of single- or multi-word terms is joined by key.  Its postings are broadcast only if they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padaflow.functions import columns as C

#: The most rows and bytes of a side that is sent to every executor; a larger one is shuffled.
POSTINGS, POSTING_BYTES = 1_000_000, 48 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes are within the bounds.  It is counted, so it should be cheap or cached."""
    width = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in df.schema.fields), F.lit(32))
    n, size = df.limit(POSTINGS + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= POSTINGS and (size or 0) <= POSTING_BYTES else df


def token_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos (from 0), token of plain Latin text, by built-in functions."""
    return docs.select("doc_id", F.posexplode(C.words(text)).alias("pos", "token"))


def full_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and all token fields, offsets into normalised text."""
    return docs.withColumn("__n", C.normalize_str(F.coalesce(text, F.lit("")))).select("doc_id", F.explode(C.tokens("__n")).alias("t")).select("doc_id", "t.*")


def keyed(tokens: DataFrame) -> DataFrame:
    """Tokens with their strict key.  Folding in place costs less than a shuffle of all tokens by their text would."""
    return tokens.withColumn("key", C.fold("token"))


def spellings(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The distinct tokens that spell a key of ``lexicon(key, ...)``, with its columns: each distinct token is folded once."""
    return tokens.select("token").distinct().withColumn("key", C.fold("token")).join(small(lexicon), "key")


def term_hits(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens that spell a key of ``lexicon(key, ...)``.  Only their few spellings are joined with the tokens, which stay where they are."""
    found = spellings(tokens, lexicon).cache()
    return tokens.join(small(found), "token")


def phrase_keys(terms: DataFrame) -> DataFrame:
    """``terms(entry, label, term)`` → entry, label, path (keys of the words), n."""
    path = F.transform(C.words("term"), lambda w: C.fold(w))
    return terms.withColumn("path", path).where("size(path) > 0").select("entry", "label", "path", F.size("path").alias("n"))


def phrase_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """All runs of tokens whose keys spell a term: doc_id, start, n, entry, label.

    The first key finds the terms by an equi-join; the rest of the path is compared in place.  Runs don't regard
    punctuation: this is the plain gazetteer join, without segments.  Terms may be of any length.
    """
    paths = phrase_keys(terms).withColumn("key", F.col("path")[0]).cache()
    longest = paths.agg(F.max("n")).first()[0] or 1
    keys = docs.select("doc_id", F.transform(C.words("text"), lambda w: C.fold(w)).alias("keys"))
    run = lambda k, i: F.struct(i.alias("start"), k.alias("key"), F.slice("keys", i + 1, F.lit(longest)).alias("ahead"))
    starts = keys.select("doc_id", F.explode(F.transform("keys", run)).alias("r")).select("doc_id", "r.*")  # what lies ahead goes along, not the whole document
    hit = starts.join(small(paths), "key")
    return hit.where(F.slice("ahead", F.lit(1), F.col("n")) == F.col("path")).select("doc_id", "start", "n", "entry", "label")


def trie_edges(paths: DataFrame) -> DataFrame:
    """parent, key, child, terminal of the trie of ``paths(path)``; nodes are key prefixes."""
    step = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    node = lambda n: F.array_join(F.slice("path", F.lit(1), n), " ")
    out = step.select(node(F.col("n") - 1).alias("parent"), F.element_at("path", F.col("n")).alias("key"), node(F.col("n")).alias("child"), (F.col("n") == F.size("path")).alias("terminal"))
    return out.groupBy("parent", "key", "child").agg(F.max("terminal").alias("terminal"))


def collisions(postings: DataFrame) -> DataFrame:
    """``postings(key, id, label, weak)`` → keys whose strong hits have several labels, with sorted ids."""
    strong = postings.where(~F.col("weak"))
    out = strong.groupBy("key").agg(F.countDistinct("label").alias("n_labels"), F.sort_array(F.collect_set("id")).alias("ids"))
    return out.where("n_labels > 1").select("key", F.array_join("ids", ",").alias("ids"))


def surface_map(terms: DataFrame) -> DataFrame:
    """form → number of entries and their sorted ids."""
    forms = terms.select("entry", C.surface_norm("term").alias("form"))
    return forms.where("form != ''").groupBy("form").agg(F.array_join(F.sort_array(F.collect_set("entry")), ",").alias("entries"))


def synonym_closure(keys: DataFrame) -> DataFrame:
    """``keys(entry, key)`` → key, others (sorted, itself included): keys of one entry stand for each other.

    An entry's keys are gathered once and sent to each of them as one list, not as pairs.
    """
    own = keys.select("entry", "key").distinct()
    lists = own.groupBy("entry").agg(F.collect_set("key").alias("all"))
    merged = own.join(lists, "entry").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("all")))).alias("others"))
    return merged


def window_keys(tokens: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Distinct keys within ``window`` tokens of ``spans(doc_id, span, first, last)``, outside of them: doc_id, span, key.

    Tokens are bucketed by the window, so that the range join is an equi-join on (doc_id, bucket).
    """
    size = window * 2 + 1
    reach = F.sequence(F.floor((F.col("first") - window) / size), F.floor((F.col("last") - 1 + window) / size))
    wide = spans.withColumn("bucket", F.explode(reach))
    near = wide.join(tokens.withColumn("bucket", F.floor(F.col("pos") / size)), ["doc_id", "bucket"])
    inside = F.col("pos").between(F.col("first") - window, F.col("last") - 1 + window)
    return near.where(inside & ~F.col("pos").between(F.col("first"), F.col("last") - 1)).select("doc_id", "span", "key").distinct()


def neighbours(spans: DataFrame, window: int) -> DataFrame:
    """``spans(doc_id, pos)`` of one token each with n, the other spans fewer than ``window`` tokens away; those without are left out.

    A frame over positions: no self-join.
    """
    frame = W.partitionBy("doc_id").orderBy("pos").rangeBetween(-window, window)
    return spans.withColumn("n", F.count("*").over(frame) - 1).where("n > 0").select("doc_id", "pos", "n")


def uncovered(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens in no span."""
    covered = spans.select("doc_id", F.explode(F.sequence("first", F.col("last") - 1)).alias("pos")).distinct()
    return tokens.join(covered, ["doc_id", "pos"], "left_anti")


def resolve(spans: DataFrame) -> DataFrame:
    """Greedy choice among overlapping ``spans(doc_id, first, last, rank, ord)``: longer first, then rank, start, ord.

    One row per document, a fold over its sorted spans; nothing is shuffled after the grouping.
    """
    item = F.struct((F.col("first") - F.col("last")).alias("size"), "rank", "first", "ord", "last")
    sorted_spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    clash = lambda kept, s: F.exists(kept, lambda k: (k["first"] < s["last"]) & (s["first"] < k["last"]))
    kind = "array<struct<size:int,rank:int,first:int,ord:int,last:int>>"
    fold = F.aggregate("all", F.array().cast(kind), lambda kept, s: F.when(clash(kept, s), kept).otherwise(F.concat(kept, F.array(s))))
    return sorted_spans.select("doc_id", F.explode(fold).alias("s")).select("doc_id", "s.first", "s.last", "s.rank", "s.ord")


def bio(tokens: DataFrame, entities: DataFrame, width: int = 64) -> DataFrame:
    """Tags of ``tokens(doc_id, pos, token, start, end)`` by ``entities(doc_id, ord, start, end, label)``; the first entity around a token counts.

    Entities go to every bucket of ``width`` offsets that they reach and tokens to that of their start, so the
    range join is an equi-join on (doc_id, bucket).
    """
    reach = F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width))
    e = entities.select("doc_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "label", "ord", F.explode(reach).alias("bucket"))
    inside = (F.col("e_start") <= F.col("start")) & (F.col("end") <= F.col("e_end"))
    near = tokens.select("doc_id", "pos", "start", "end", F.floor(F.col("start") / width).alias("bucket")).join(e, ["doc_id", "bucket"])
    hit = near.where(inside).groupBy("doc_id", "pos").agg(F.min(F.struct("ord", "e_start", "label")).alias("e"))
    tag = F.when(F.col("e").isNull(), "O").otherwise(F.concat(F.when(F.col("e.e_start") == F.col("start"), "B-").otherwise("I-"), "e.label"))
    return tokens.join(hit, ["doc_id", "pos"], "left").select("doc_id", "pos", "token", tag.alias("tag"))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / (lengths), as a fold over the characters of ``a``."""
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(last: Column, ch: Column) -> Column:
        j = F.sequence(F.lit(1), F.length(b))
        return F.aggregate(
            F.when(F.length(b) > 0, j).otherwise(F.array().cast("array<int>")),
            F.array(F.lit(0)),
            lambda now, i: F.concat(now, F.array(F.when(F.substring(b, i, F.lit(1)) == ch, last[i - 1] + 1).otherwise(F.greatest(last[i], now[i - 1])))),
        )

    lcs = F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), row, step), -1)
    return F.when(F.length(a) + F.length(b) == 0, 100.0).otherwise(lcs * 200.0 / (F.length(a) + F.length(b)))


def fuzzy_matches(keys: DataFrame, pool: DataFrame, length: int = 6, score: float = 88.0) -> DataFrame:
    """``keys(key)`` against ``pool(term)``: the best term of the same first letter and a length within 1.

    An equi-join on (letter, length); ties go to the least term.
    """
    k = keys.where(F.length("key") >= length).select("key", F.substring("key", 1, 1).alias("letter"), F.explode(F.sequence(F.length("key") - 1, F.length("key") + 1)).alias("len"))
    p = pool.where(F.length("term") >= length - 1).select("term", F.substring("term", 1, 1).alias("letter"), F.length("term").alias("len")).distinct()
    scored = k.join(p, ["letter", "len"]).withColumn("score", indel_ratio(F.col("key"), F.col("term"))).where(F.col("score") >= score)
    best = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rn", best).where("rn = 1").select("key", "term", "score")
