"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and one failure bit a rule; policies are
versioned masks over those bits, so a new policy or an ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulo.llm.common import let

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_words": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 15 * c("n_words"),
    }


RULE_NAMES = ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")
#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": RULE_NAMES,
}


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << RULE_NAMES.index(n) for n in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, of the hashes of all windows in order."""

    def covered(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when((same(j, j - 1) & (j > 0)) | same(j, j + 1), F.get(s, j)["i"]))
        step = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x + WINDOW - a["end"])).alias("n"), (x + WINDOW).alias("end")))["n"]
        return step(F.array_sort(F.filter(at, lambda x: x.isNotNull())))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Words are runs of characters other than space and tab to carriage return. ``n_lines`` counts lines with a word. Windows
    are told apart by 64-bit hashes within one document. Null texts measure as empty ones.
    """

    def lines(ls: Column) -> Column:
        return let(F.filter(ls, lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda w: F.struct(F.size(w).alias("n"), (F.size(w) - F.size(F.array_distinct(w))).alias("dup")))

    def of_text(t: Column) -> Column:
        def of_words(h: Column) -> Column:
            n = F.size(h)
            shingles = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
            repeated = let(shingles, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.lit(0)).otherwise(_repeated(s)))
            return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))

        hashed = F.transform(F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
        solid = F.length(F.translate(t, SPACES, ""))
        symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
        return F.struct(let(hashed, of_words).alias("w"), let(F.split(t, "\n"), lines).alias("l"), solid.cast("long").alias("chars"), symbols.cast("long").alias("symbols"))

    m = docs.withColumn("__m", let(F.coalesce(F.col(text_col), F.lit("")), of_text))
    fields = {"n_words": "w.n_words", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_lines": "l.n", "n_repeat_words": "w.n_repeat_words"}
    return m.withColumn("m", F.struct(*[F.col(f"__m.{path}").cast("long").alias(n) for n, path in fields.items()])).drop("__m")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits``: bit i is set if the document fails rule i of RULE_NAMES.

    One pass without a shuffle. Rows keep their number: repeated rows give repeated entries, null texts count as empty (and
    fail few_words), other columns are not read.
    """
    m = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "m.*")
    rules = _rules()
    bits = [F.when(rules[n], F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(RULE_NAMES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("fail_bits", total.cast("long"))


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = "v2") -> DataFrame:
    """The ledger with ``base_failed``, ``policy`` and ``kept`` under a version or a set of rules. The base rules always hold."""
    hit = lambda bits: F.col("fail_bits").bitwiseAND(F.lit(bits)) != 0
    name = policy if isinstance(policy, str) else "+".join(policy)
    return entries.withColumns({"base_failed": hit(mask("base")), "policy": F.lit(name), "kept": ~hit(mask("base") | mask(policy))})


def ablations(entries: DataFrame, policy: str | tuple[str, ...] = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that the policy would keep without it.

    One aggregation over the bits with one row a task; nothing is evaluated again. An empty ledger gives zeros.
    """
    active = mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(active))
    names = [n for n in RULE_NAMES if active >> RULE_NAMES.index(n) & 1]
    sums = []
    for n in names:
        b = 1 << RULE_NAMES.index(n)
        sums += [F.count(F.when(bits.bitwiseAND(F.lit(b)) != 0, 1)).alias(f"f_{n}"), F.count(F.when(bits == b, 1)).alias(f"o_{n}")]
    row = entries.agg(F.count("*").alias("n"), F.count(F.when(bits == 0, 1)).alias("kept"), *sums)
    each = [F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("failed_alone"), (F.col("kept") + F.col(f"o_{n}")).alias("kept_without"), F.col("n").alias("documents")) for n in names]
    return row.select(F.explode(F.array(*each)).alias("a")).select("a.*")


def digest(docs: DataFrame) -> DataFrame:
    out = apply_policy(ledger(docs), "v2")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS s
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, (n_words < 10) AS b0, (100 * n_repeat_words > 20 * n_words) AS b1, (10 * n_symbols > n_words) AS b2,
        (100 * n_dup_lines > 30 * n_lines) AS b3, (word_chars < 2 * n_words) AS b4, (word_chars > 15 * n_words) AS b5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed,
  NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS kept,
  (b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT)::BIGINT AS fail_bits
FROM f
"""
