"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four rules (email, ip, card, phone). The method looks at every word
that holds a digit or an ``@`` (candidates): labelers vote +1, -1 or abstain on it (shapes by regular
expression, a gazetteer of mail hosts and key prefixes, the word before it). Candidates are
grouped by their votes and shape features; that table has at most a fixed number of rows
(``MAX_PATTERNS``, from the number of labelers and buckets), whatever the corpus, and on it
expectation-maximisation estimates each labeler's reliability (how it votes on true and
false spans) and each candidate's probability. These probabilities train a logistic span
classifier over votes and shape features, whose weights go back into a column expression;
candidates at 0.5 or more that meet no base span are added as kind ``other``.

Positions are code points: the pieces between matches and the matches add up to the text,
so a running sum of their lengths gives every span. Patterns are written so that matching
is linear in the text (runs are entered at their start only, nothing is retried), with the
same matches as the plain rules.

Defined results: null and empty texts have no spans (``base_sha256`` of the empty string);
rows that repeat an id are rows of their own; a corpus without candidates adds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "other")
CANDIDATE = "candidate"

# The contract's rules, entered only at the start of a run or right after a match (\G), with
# possessive repeats where the next character cannot be one of the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    CANDIDATE: r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
}
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# fixed values: gazetteer and cue words
MAIL_HOSTS = ("gmail.", "yahoo.", "hotmail.", "outlook.", "icloud.", "proton.", "mail", "example.")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-")
CUES = ("call", "phone", "tel", "mobile", "fax", "email", "mail", "contact", "ip", "host", "card", "visa", "iban", "ssn",
        "passport", "password", "passwd", "secret", "token", "key", "api_key", "apikey", "id", "user", "login")

LABELERS = ("email_shape", "ip_shape", "card_shape", "phone_shape", "secret_shape", "mail_host", "key_prefix",
            "cue_before", "plain_number", "only_name")
BUCKETS = (("size", 5), ("digits", 4), ("mixed", 2))
MAX_PATTERNS = 3 ** len(LABELERS) * 40          # no table can have more rows; in practice some dozens
EM_ROUNDS, FIT_ROUNDS = 30, 200


def _matches(text: Column, kind: str, guard: Column) -> Column:
    """array<struct<kind, i, gap, m, ctx>>: match, length and last characters of what lies before it."""
    pattern = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    rows = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["p"]).alias("gap"), x["m"].alias("m"),
        (F.right(x["p"], F.lit(40)) if kind == CANDIDATE else F.lit("")).alias("ctx")))
    return F.when(guard, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,m:string,ctx:string>>"))


def find_matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, matches of every row: the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit, at, plus = text.rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    guards = {"email": at, "ip": digit, "card": digit, "phone": plus, CANDIDATE: digit | at}
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                       F.concat(*[_matches(text, k, g) for k, g in guards.items()]).alias("matches"))


def _is_valid() -> Column:
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    return (F.when(F.col("kind") == "ip", F.col("m").rlike(IP_PARTS))
            .when(F.col("kind") == "card", n.between(13, 19) & F.call_function("luhn_check", digits))
            .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(True))


def _vote(plus: Column, minus: Column | None = None) -> Column:
    out = F.when(plus, 1)
    return (out.when(minus, -1) if minus is not None else out).otherwise(0)


def votes_and_buckets() -> dict[str, Column]:
    """Labelers and shape features of a candidate ``m`` with the text ``ctx`` before it."""
    m = F.col("m")
    bare = F.regexp_replace(m, r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    low = F.lower(m)
    before = F.lower(F.regexp_extract("ctx", r"([A-Za-z_]{1,20})[^A-Za-z_\x20]{0,3}[\x20\x09-\x0D]+$", 1))
    letters, size = m.rlike("[A-Za-z]"), F.length(bare)
    has = lambda words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w))), True)
    number = bare.rlike(r"^[0-9]{1,4}(?:[.,:/%-][0-9]{1,4})?%?$")
    return {
        "email_shape": _vote(m.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z]"), F.contains(m, F.lit("@")) & ~m.rlike(r"@[A-Za-z0-9]")),
        "ip_shape": _vote(bare.rlike(IP_PARTS), bare.rlike(r"^[0-9]+\.[0-9]+$")),
        "card_shape": _vote(n.between(13, 19) & ~letters & F.call_function("luhn_check", digits), n.between(13, 19) & ~letters & ~F.call_function("luhn_check", digits)),
        "phone_shape": _vote(bare.rlike(r"^\+[0-9]{2,}|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}[-.][0-9]{3,4}[-.][0-9]{4}$")),
        "secret_shape": _vote(m.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?[:=]")
                              | (letters & (size >= 16) & (n >= 4) & bare.rlike(r"^[A-Za-z0-9_+/=-]+$"))),
        "mail_host": _vote(F.contains(m, F.lit("@")) & has(MAIL_HOSTS)),
        "key_prefix": _vote(bare.rlike("^(?:" + "|".join(p.replace("-", "[-]") for p in KEY_PREFIXES) + ")")),
        "cue_before": _vote(before.isin(*CUES)),
        "plain_number": _vote(F.lit(False), number),
        "only_name": _vote(F.lit(False), letters & (n <= 2) & ~F.contains(m, F.lit("@")) & ~F.contains(m, F.lit("="))),
        "size": F.when(size <= 4, 0).when(size <= 8, 1).when(size <= 14, 2).when(size <= 24, 3).otherwise(4),
        "digits": F.when(n == 0, 0).when(n <= 4, 1).when(n <= 10, 2).otherwise(3),
        "mixed": F.when(letters & (n > 0), 1).otherwise(0),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict, list[float]]:
    """Expectation-maximisation over (votes, count). Returns per labeler and class the
    probabilities of the votes, and each pattern's probability of a true span."""
    n = len(LABELERS)
    prob = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns]          # start: the majority
    rates: dict = {}
    for _ in range(EM_ROUNDS):
        mass = [1.0, 1.0]
        seen = [[{-1: 0.1, 0: 0.1, 1: 0.1} for _ in range(n)] for _ in (0, 1)]
        for (v, c), p in zip(patterns, prob):
            for y, w in ((1, p * c), (0, (1 - p) * c)):
                mass[y] += w
                for j in range(n):
                    seen[y][j][v[j]] += w
        total = sum(mass)
        rates = {y: [{k: x / sum(s.values()) for k, x in s.items()} for s in seen[y]] for y in (0, 1)}
        prob = []
        for v, _ in patterns:
            z = math.log(mass[1] / total) - math.log(mass[0] / total)
            # a vote can only speak for its own sign, so the two classes cannot swap
            for j in range(n):
                step = math.log(rates[1][j][v[j]]) - math.log(rates[0][j][v[j]])
                z += max(0.0, step) if v[j] > 0 else min(0.0, step) if v[j] < 0 else 0.0
            prob.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return rates, prob


def features(votes: tuple[int, ...], buckets: tuple[int, ...]) -> list[int]:
    """Indices of the classifier's active features: 0 is the bias."""
    out = [0]
    for j, v in enumerate(votes):
        if v:
            out.append(1 + 2 * j + (v > 0))
    at = 1 + 2 * len(LABELERS)
    for (_, size), b in zip(BUCKETS, buckets):
        out.append(at + b)
        at += size
    return out


N_FEATURES = 1 + 2 * len(LABELERS) + sum(s for _, s in BUCKETS)


def fit_classifier(rows: list[tuple[tuple[int, ...], tuple[int, ...], int, float]]) -> list[float]:
    """Logistic weights from (votes, buckets, count, probability)."""
    w, step = [0.0] * N_FEATURES, [0.3] * N_FEATURES
    last = [0.0] * N_FEATURES
    total = sum(c for _, _, c, _ in rows) or 1
    act = [(features(v, b), c / total, p) for v, b, c, p in rows]
    for _ in range(FIT_ROUNDS):
        g = [-1e-3 * x for x in w]
        for f, c, p in act:
            e = c * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in f))))))
            for i in f:
                g[i] += e
        for i in range(N_FEATURES):
            s = g[i] * last[i]
            step[i] = min(2.0, step[i] * 1.2) if s > 0 else step[i] * 0.5 if s < 0 else step[i]
            w[i] += math.copysign(step[i], g[i]) if g[i] else 0.0
        last = g
    return w


def _score(w: list[float]) -> Column:
    z = F.lit(w[0])
    for j, name in enumerate(LABELERS):
        z = z + F.when(F.col(name) > 0, w[2 + 2 * j]).when(F.col(name) < 0, w[1 + 2 * j]).otherwise(0.0)
    at = 1 + 2 * len(LABELERS)
    for name, size in BUCKETS:
        z = z + F.element_at(F.array(*[F.lit(x) for x in w[at:at + size]]), F.col(name) + 1)
        at += size
    return z


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other: one row per row."""
    found = materialize(find_matches(docs, id_col, text_col), "pii-matches")
    run = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = (found.filter(F.size("matches") > 0).select("uid", F.explode("matches").alias("x")).select("uid", "x.*")
             .withColumn("end", F.sum(F.col("gap") + F.length("m")).over(run).cast("long"))
             .withColumn("start", F.col("end") - F.length("m")))
    spans = materialize(spans.withColumn("valid", _is_valid()).filter("valid").select("uid", "kind", "start", "end", "m", "ctx"), "pii-spans")
    base = spans.filter(F.col("kind") != CANDIDATE).select("uid", "kind", "start", "end")

    judged = spans.filter(F.col("kind") == CANDIDATE).withColumns(votes_and_buckets())
    names = [*LABELERS, *(b for b, _ in BUCKETS)]
    table = judged.groupBy(*names).agg(F.count("*").alias("c")).orderBy(*names).collect()      # at most MAX_PATTERNS rows
    k = len(LABELERS)
    patterns: dict[tuple[int, ...], int] = {}
    for r in table:
        patterns[tuple(r)[:k]] = patterns.get(tuple(r)[:k], 0) + r.c
    _, prob = estimate(list(patterns.items()))
    prob = dict(zip(patterns, prob))
    w = fit_classifier([(tuple(r)[:k], tuple(r)[k:-1], r.c, prob[tuple(r)[:k]]) for r in table])

    # what the classifier takes, without candidates that meet a base span of their document
    taken = judged.filter(_score(w) >= 0.0).select("uid", F.lit("other").alias("kind"), "start", "end")
    both = base.unionByName(taken)
    is_base = F.col("kind") != "other"
    by_start = Window.partitionBy("uid").orderBy("start", "end", "kind")
    upto = by_start.rowsBetween(Window.unboundedPreceding, 0)
    after = by_start.rowsBetween(0, Window.unboundedFollowing)
    both = (both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(upto))
            .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after)))
    clear = ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    all_spans = both.filter(is_base | clear).select("uid", "kind", "start", "end")

    order = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    listed = all_spans.groupBy("uid").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in KINDS],
        F.array_sort(F.collect_list(F.struct(order[F.col("kind")].alias("o"), "start", "end", "kind"))).alias("all"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    listed = listed.select("uid", *[f"n_{kind}" for kind in KINDS],
                           text(F.filter("all", lambda x: x["kind"] != "other")).alias("base"), text(F.col("all")).alias("spans"))
    zero = F.lit(0).cast("long")
    return found.select("uid", "doc_id").join(listed, "uid", "left").select(
        "doc_id", *[F.coalesce(f"n_{kind}", zero).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))
