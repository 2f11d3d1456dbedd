"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each text is matched against patterns; a match's value is hashed, and the hashes
are counted over the whole corpus by distinct owners and repositories.  A value
that many owners share, or that stands in many repositories of more than one
owner, is a copied example; one that is its owner's own, in however many
repositories of that owner, and that does not look like a filler is live.  Matches of the base kinds are always
reported; matches of the added kinds are reported unless they are copied
examples.

Positions come from the pieces between matches: the same leftmost search splits
a text and extracts its matches, so running sums of lengths are the matches'
offsets in code points.  Texts go through the scan once and are not shuffled;
only matches are.  The join with the counts is salted, so a value in a third of
all rows is spread over tasks.

Defined results: null and empty texts have no matches; a null owner counts as an
owner of its own; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.llm.shared import written

# Patterns (Java syntax), the group that holds the value, and the value's or match's least length.
# Base kinds come first, in the order in which matches at one place are listed.  Where a run is matched whole, its
# least length is in the pattern: a shorter run holds no longer one, so the same matches are left as by dropping later.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i)(?:password|passwd|secret|token|api_?key)"),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
]
#: A private key's whole block, the body its value: up to the END line, or as far as base64 goes where that is cut off.
_BREAK = r"(?:\s|\\[nr])"
_END = r"-----END [A-Z ]{0,20}PRIVATE KEY-----"
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----("
    rf"[^-]*+(?:-(?!----)[^-]*+)*+(?={_END})"
    rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]++)*+(?:{_BREAK}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_BREAK}++[A-Za-z0-9+/=]++(?={_BREAK}*+(?:[\r\n-]|\\n|$)))?+"
    rf")(?:{_END})?+"
)
ADDED = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, r"xox[abprs]-"),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39, r"AIza[A-Za-z0-9_-]{35}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, r"eyJ[A-Za-z0-9_-]+\."),
    ("pem", _PEM, 1, 20, r"PRIVATE KEY-----"),
    ("login", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", 1, 6, r"://[^\s/@]{1,130}@"),
]
KINDS = BASE + ADDED
PEM = [k for k, *_ in KINDS].index("pem")
#: A value of so many owners or more is a copied example.
EXAMPLE_OWNERS = 3
#: So is a value of two owners or more in so many repositories or more.
EXAMPLE_REPOSITORIES = 5
#: Different characters that a live value has at least.
LIVE_CHARACTERS = 6
SALTS = 16


def _hits(text: Column, pattern: str, group: int, quick: str, rank: int) -> Column:
    """Lengths between matches, the matches' lengths and values, of one kind; null where there is surely none."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    found = F.struct(
        F.lit(rank).alias("rank"),
        F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)).alias("gaps"),
        F.transform(whole, lambda x: F.char_length(x)).alias("lengths"),
        value.alias("values"),
    )
    return F.when(text.rlike(quick), found)


def matches(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Written: (row, doc_id, text_hash, owner, repository, kinds): a row of docs each, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(owner.cast("string"), F.lit("\x00")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("\x00")).alias("repository"))
    kinds = F.filter(F.array(*[_hits(F.col("text"), p, g, q, k) for k, (_, p, g, _, q) in enumerate(KINDS)]), lambda x: x.isNotNull())
    return written(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repository", kinds.alias("kinds")), "secret-matches", compression="zstd")


def candidates(found: DataFrame) -> DataFrame:
    """Written: (row, owner, repository, rank, start, end, value_hash, varied) of each match that is long enough."""
    least = F.element_at(F.array(*[F.lit(n) for _, _, _, n, _ in KINDS]), F.col("rank") + 1)
    kind = found.where(F.size("kinds") > 0).select("row", "owner", "repository", F.inline("kinds"))
    # as many gaps as matches and one more; the last gap has no match and is left out
    each = kind.select("row", "owner", "repository", "rank", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("lengths")).alias("gap"), F.col("lengths").alias("size"), F.col("values").alias("value"))).alias("k", "m"))
    # one key is one value, however its lines are broken
    value = F.when(F.col("rank") == PEM, F.regexp_replace("m.value", _BREAK, "")).otherwise(F.col("m.value"))
    each = each.select("row", "owner", "repository", "rank", "k", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"), value.alias("value"))
    so_far = Window.partitionBy("row", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far)
    placed = each.select("row", "owner", "repository", "rank", (end - F.col("size")).alias("start"), end.alias("end"), "value")
    own = placed.where(F.char_length("value") >= least)
    varied = F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS
    return written(own.select("row", "owner", "repository", "rank", "start", "end", F.sha2("value", 256).alias("value_hash"), varied.alias("varied")), "secret-candidates", compression="zstd")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories, n_matches) over the whole corpus; equal rows are summed before the shuffle."""
    pairs = found.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("value_hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("owner", "repository").alias("n_repositories"), F.sum("n").alias("n_matches"))


def classified(found: DataFrame, facts: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Candidates with n_owners, n_repositories and verdict: example, live or plain."""
    salted = found.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    spread = facts.select("value_hash", "n_owners", "n_repositories", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= example_repositories))
    verdict = F.when(copied, "example").when(F.col("varied"), "live").otherwise("plain")
    return salted.join(spread.hint("merge"), ["value_hash", "salt"]).drop("salt").withColumn("verdict", verdict)


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Secrets of each row of docs(doc_id, text, ...): doc_id, text_hash, n_assign, n_access, n_hex, n_live, n_example, found.

    found is an array of (start, rank, end, verdict, n_owners, n_repositories) of
    all reported matches; rank numbers KINDS.  owner and repository are columns of docs.
    """
    rows = matches(docs, owner, repository)
    found = candidates(rows)
    judged = classified(found, ownership(found), example_owners, example_repositories)
    kept = judged.where((F.col("rank") < len(BASE)) | (F.col("verdict") != "example"))
    each = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "verdict", "n_owners", "n_repositories"))).alias("found"))
    none = F.array().cast(each.schema["found"].dataType)
    both = rows.select("row", "doc_id", "text_hash").join(each.hint("merge"), "row", "left").withColumn("found", F.coalesce("found", none))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    ranked = lambda k: lambda x: x["rank"] == k
    counts = [count(ranked(k)).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return both.select("doc_id", "text_hash", *counts, count(lambda x: x["verdict"] == "live").alias("n_live"), count(lambda x: x["verdict"] == "example").alias("n_example"), "found")


def digests(scanned: DataFrame) -> DataFrame:
    """The scan with its spans written out: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, owners, repositories.

    owners and repositories list, span by span, how many distinct ones share the value.
    """
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    listed = lambda n: F.array_join(F.transform("found", lambda x: x[n].cast("string")), ",").alias(n.removeprefix("n_"))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "n_live", "n_example", listed("n_owners"), listed("n_repositories"))


def redacted(docs: DataFrame, owner: Column, repository: Column, mark: str = "[secret]") -> DataFrame:
    """docs with the live matches of each text replaced by mark; columns stay as they are, n_chars (if there) is counted anew.

    Only texts with a live match are moved for this.
    """
    names = docs.columns
    live = F.filter("found", lambda x: x["verdict"] == "live")
    spans = scan(docs, owner, repository).select("doc_id", "text_hash", live.alias("live")).where(F.size("live") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = written(spans, "live-secrets", compression="zstd").select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "live")
    text = F.coalesce(F.col("text"), F.lit(""))
    maybe = F.lit(False)
    for _, _, _, _, quick in KINDS:
        maybe = maybe | text.rlike(quick)
    some = docs.where(maybe).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("w_id")) & (F.xxhash64(text) == F.col("w_hash")), "left")
    # spans of kinds may overlap: what lies before the furthest end so far is not written again
    step = F.aggregate(
        "live",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(
            F.when(x["end"] <= acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int")), F.lit(mark))).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
    )
    changed = some.withColumn("w_step", F.when(F.col("live").isNotNull(), step))
    new_text = F.when(F.col("live").isNull(), F.col("text")).otherwise(F.concat("w_step.out", F.substring(F.col("text"), (F.col("w_step.at") + 1).cast("int"), F.lit(2**31 - 1))))
    # a column of its own first: n_chars is counted on the new text
    changed = changed.withColumn("w_text", new_text)
    cols = [F.col("w_text").alias("text") if n == "text" else F.when(F.col("live").isNull(), F.col(f"`{n}`")).otherwise(F.char_length("w_text")).cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else F.col(f"`{n}`") for n in names]
    return changed.select(*cols).unionByName(docs.where(~maybe).select(*[F.col(f"`{n}`") for n in names]))
