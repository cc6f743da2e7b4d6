"""URL filters: fixed host and path rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import discard, written

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1), _LETTERS, _LETTERS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: host labels with their place from the right, path segments (digits are 0), query keys; none without host and path."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\A(?s:.*?)://[^?#]*\?([^#]*)", 1)
    given = lambda parts: F.filter(parts, lambda x: x != "")
    hosts = F.transform(F.reverse(F.split(host, r"\.")), lambda x, k: F.concat(F.lit("h"), k.cast("string"), F.lit(":"), x))
    paths = F.transform(given(F.split(path, "/")), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(given(F.split(query, "&")), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(hosts, paths, keys)))


@dataclass(frozen=True)
class HostRule:
    """A rule on a host, all its subdomains, and paths that start with path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class MinedRule:
    """URLs that have all these tokens carry the label with this confidence; support: labelled URLs that have the tokens and the label, as a share."""

    tokens: tuple[str, ...]
    support: float
    confidence: float


class HostIndex:
    """Rules by host; the host's suffixes are looked up, and of the rules that fit the longest wins."""

    def __init__(self, rules: Iterable[HostRule]):
        self.of: dict[str, list[HostRule]] = defaultdict(list)
        for r in rules:
            self.of[r.host].append(r)

    def match(self, host: str, path: str) -> HostRule | None:
        best, suffix = None, host
        while suffix:
            for r in self.of.get(suffix, ()):
                if path.startswith(r.path) and (best is None or (len(str(r)), str(r)) > (len(str(best)), str(best))):
                    best = r
            suffix = suffix.partition(".")[2]
        return best


class TokenIndex:
    """Inverted index of token combinations: a rule matches when as many of a URL's tokens point at it as it has tokens."""

    def __init__(self, combinations: Sequence[Sequence[str]]):
        self.sizes = [len(c) for c in combinations]
        self.of: dict[str, list[int]] = defaultdict(list)
        for k, tokens in enumerate(combinations):
            for t in tokens:
                self.of[t].append(k)

    def match(self, tokens: Iterable[str]) -> list[int]:
        met = Counter(k for t in tokens for k in self.of.get(t, ()))
        return sorted(k for k, n in met.items() if n == self.sizes[k])


def surely(hits: int, n: int, z: float = 1.96) -> float:
    """The lower end of Wilson's interval for a share of which hits of n were seen."""
    p = hits / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def _parts(items: list[str], most: int) -> list[list[str]]:
    """Sets of at most six items that hold together every three of the items; the items themselves if they are few."""
    if len(items) <= most:
        return [items]
    pairs = [items[k : k + 2] for k in range(0, len(items), 2)]
    return [sum(some, []) for some in combinations(pairs, min(3, len(pairs)))]


def mine_rules(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = 0.002, min_confidence: float = 0.6, max_tokens: int = 3, min_hits: int = 6, most_items: int = 10) -> list[MinedRule]:
    """Combinations of at most max_tokens (3 at most) tokens whose URLs carry label 1, pruned by support and confidence.

    FP-growth mines the combinations of the URLs with label 1; an inverted index then counts each
    combination over all labelled URLs, which gives its confidence. min_confidence bounds the confidence that is sure (the lower end of
    Wilson's interval), so few URLs make no rule by chance. A combination that holds a smaller
    one of as much confidence is dropped. A rule has label 1 in min_support of all labelled URLs and in min_hits at least. Null labels and URLs without tokens
    aren't counted; repeated rows count each.

    FP-growth finds combinations of any size, exponentially many in a long URL. So tokens that too few URLs with label 1 have
    are left out, and a URL that still has more than most_items goes as sets of six that hold every three of them
    (cubic in its frequent tokens); that counts some combinations too often, which the counting after it puts right.
    The list is as long as min_support allows and doesn't grow with the table, so it is kept on the driver.
    """
    from pyspark.ml.fpm import FPGrowth

    if not 1 <= max_tokens <= 3:
        raise ValueError("max_tokens must be 1, 2 or 3")
    rows = labelled.filter(F.col(label_col).isNotNull()).select(tokens_of(F.col(url_col)).alias("items"), (F.col(label_col) == 1).cast("int").alias("label")).filter(F.size("items") > 0)
    # Equal token sets are one row with a count, so a host with a third of all URLs is few rows.
    rows = written(rows.groupBy(F.array_sort("items").alias("items")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")), "urls")
    total, hits = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))).first()
    least = max(min_hits, -int(-min_support * total // 1))
    if hits < least:
        discard(rows)
        return []
    often = rows.filter("hits > 0").select(F.explode("items").alias("token"), "hits").groupBy("token").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= least)
    # A set of tokens with enough hits by itself needs no more copies than that to be found.
    few = rows.filter("hits > 0").select(F.col("items").alias("of"), F.explode("items").alias("token"), F.least("hits", F.lit(least)).alias("copies"))
    few = few.join(F.broadcast(often.select("token")), "token").groupBy("of", "copies").agg(F.array_sort(F.collect_list("token")).alias("items"))
    parts = F.udf(lambda items: _parts(items, most_items), T.ArrayType(T.ArrayType(T.StringType())))
    short = few.filter(F.size("items") <= most_items).select("items", "copies")
    long = few.filter(F.size("items") > most_items).select(F.explode(parts("items")).alias("items"), "copies")
    sets = written(short.unionByName(long).groupBy("items").agg(F.least(F.sum("copies"), F.lit(least)).cast("int").alias("copies")), "sets")
    copies = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    frequent: list[tuple[str, ...]] = []
    if copies:
        given = sets.select("items", F.explode(F.sequence(F.lit(1), "copies")).alias("_")).select("items")
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / copies), minConfidence=1.0).fit(given).freqItemsets
        frequent = [tuple(sorted(r["items"])) for r in found.filter(F.size("items") <= max_tokens).select("items").collect()]
    index = TokenIndex(frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = Counter(), Counter()
        for batch in batches:
            for row in batch.to_pylist():
                for c in index.match(row["items"]):
                    n[c] += row["n"]
                    k[c] += row["hits"]
        yield pa.RecordBatch.from_pydict({"c": pa.array(list(n), pa.int64()), "n": pa.array(list(n.values()), pa.int64()), "hits": pa.array([k[c] for c in n], pa.int64())})

    counts = rows.mapInArrow(counted, "c long, n long, hits long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter(F.col("hits") >= least).collect()
    discard(rows, sets)
    rules = [MinedRule(frequent[r["c"]], r["hits"] / total, r["hits"] / r["n"]) for r in counts if surely(r["hits"], r["n"]) >= min_confidence]
    rules = sorted(rules, key=lambda r: (len(r.tokens), r.tokens))
    kept: list[MinedRule] = []
    smaller = TokenIndex([r.tokens for r in rules])
    for k, r in enumerate(rules):
        if not any(j != k and rules[j].confidence >= r.confidence for j in smaller.match(r.tokens)):
            kept.append(r)
    return kept


def judge_urls(pages: DataFrame, fixed: Sequence[HostRule], mined: Sequence[MinedRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, mined for each row.

    Of the fixed rules that fit, the longest decides (of equal lengths the last in order). Where none
    fits, rule is null and a URL that a mined rule matches is blocked, others are allowed; mined holds
    the tokens of the first such rule. A null URL, or one without ``://``, has an empty host and path and
    is allowed. Repeated rows are judged alike; other columns aren't read; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "mined")])
    arrow = to_arrow_schema(schema)
    hosts, tokens, mined = HostIndex(fixed), TokenIndex([r.tokens for r in mined]), list(mined)

    def one(host: str, path: str, has: list[str]) -> tuple:
        rule = hosts.match(host, path)
        hit = tokens.match(has) if rule is None else []
        return str(rule) if rule else None, rule.verdict if rule else "block" if hit else "allow", " & ".join(mined[hit[0]].tokens) if hit else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            columns = [*batch.columns[:3], *(pa.array([x[k] for x in found], pa.string()) for k in range(3))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    url = F.col(url_col)
    return pages.select(F.col(id_col), host_of(url).alias("__host"), path_of(url).alias("__path"), tokens_of(url).alias("__tokens")).mapInArrow(judge, schema)


def labelled_urls(pages: DataFrame, labels: DataFrame, label: Column, id_col: str = "page_id", label_id: str = "doc_id", url_col: str = "url", junk: Sequence[str] = ()) -> DataFrame:
    """url, label of the pages that labels has by id, and of those whose host has one of the junk words, which is label 1.

    An id that labels has several times takes its greatest label; repeated pages count each. Null ids and null labels carry none.
    """
    by = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.max(label.cast("int")).alias("label"))
    found = pages.select(F.col(id_col).alias("__of"), F.col(url_col).alias("url")).join(by, F.col("__of") == F.col("__id"), "left")
    words = F.split(host_of(F.col("url")), "[^a-z]+")
    known = F.when(F.arrays_overlap(words, F.array(*map(F.lit, junk))), 1).otherwise(F.col("label")) if junk else F.col("label")
    return found.select("url", known.alias("label")).filter("label IS NOT NULL")
