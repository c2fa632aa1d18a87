"""Personal data by weak supervision; DataFrame functions only.

Four kinds have base patterns, whose valid matches are always personal data. Wider patterns
find candidates beside them: obfuscated addresses, numbers that stand next to others, other
separators. Labelers vote on each candidate: by form and checksum, by gazetteers, by the
words and signs around it. Expectation-maximisation estimates how reliable each labeler is
from how they agree, without labels, and the posteriors train the final classifier of spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolguard.functions.constants import constant, let
from toolguard.scale import materialize, one_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in a form that looks at each character a bounded number of times: a match starts
# where a run of its characters starts, or where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?+[(\[](?:at|AT)[)\]]\x20?+|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?+[(\[](?:dot|DOT)[)\]]\x20?+|\x20(?:dot|DOT)\x20)"
#: Candidates: every span that the labelers vote on.
WIDER = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\x20?+\(dot\)\x20?+)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}[\x20.-][0-9]{6}[\x20.-][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?=[+(0-9])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}(?:[\x20.-][0-9]{2,4}){0,3}(?![0-9])",
}
#: What texts with a valid match of either pattern of a kind hold; others are not searched.
HOLDS = {"ip": r"[0-9](?:\.|\[\.\]|\x20?\(dot\)\x20?)[0-9]", "card": r"[0-9](?:[\x20./-]?[0-9]){12}", "phone": r"[0-9]\)?[\x20./()-]{1,2}[0-9]|\+[0-9]"}

# Gazetteers, fixed values: ends of host names, first digits of card issuers, calling codes.
HOSTS = "com org net edu gov mil int info biz io dev app co me eu de at ch fr es it nl be pl pt se no dk fi uk ie us ca mx br ar au nz jp cn in kr ru za".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|30|38|39|6011|64|65|62|50|5[6-9]|63|67)"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 370 371 372 380 385 386 420 421 852 886 971 972".split()
#: Words that are written before personal data of each kind, and before other numbers and names.
BEFORE = {
    "email": "mail email e-mail contact write address reply correo courriel kontakt".split(),
    "ip": "ip ipv4 host server address client from gateway adresse dirección".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta paid".split(),
    "phone": "phone tel telephone call mobile fax whatsapp cell telefon téléphone teléfono anruf handy".split(),
}
AGAINST = "version ver build release order invoice isbn issn doi ref id no nr page section chapter sku part token key hash serial".split()

LABELERS = ("form", "check", "known", "context", "against", "edges")
#: Values of a feature at most, and rounds of expectation and maximisation.
VALUES = 16
ROUNDS = 10
#: Characters around a span that labelers see.
NEAR_BEFORE, NEAR_AFTER = 32, 16
THRESHOLD = 0.5


def _pieces(text: Column, kind: str, base: bool) -> Column:
    """Each match with the length of the text before it and what stands around; the last has no match. NULL without any."""
    pattern = (BASE if base else WIDER)[kind]
    zipped = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda x, gap: F.struct(
            x.alias("x"), F.length(gap).cast("long").alias("gap"), F.right(gap, F.lit(NEAR_BEFORE)).alias("before"), F.left(gap, F.lit(NEAR_AFTER)).alias("head")
        ),
    )
    if kind == "email":
        may = one_of([text.contains(x) for x in ("@", *(() if base else ("dot", "DOT")))])
    else:
        may = text.rlike(HOLDS[kind])
    return F.when(may, let(zipped, lambda z: F.when(F.size(z) > 1, z)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check digit."""
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    at = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    values = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def is_valid(kind: Column, x: Column) -> Column:
    """The conditions of the base patterns on their matches."""
    n = F.length(digits(x))
    return (
        F.when(kind == "ip", x.rlike(_IP))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits(x))).otherwise(False))
        .when(kind == "phone", n.between(8, 15)).otherwise(True)
    )


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``, -1 where ``no`` (without it, wherever not), 0 otherwise."""
    return F.when(yes, 1).otherwise(F.lit(-1) if no is None else F.when(no, -1).otherwise(0))


def _words(words: list[str]) -> str:
    return r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(words) + r")[^\p{L}\p{N}]"


def votes() -> Column:
    """What each labeler says of (kind, x, before, after), as an array of -1, 0 and 1."""
    kind, x, before, after = F.col("kind"), F.col("x"), F.col("before"), F.col("after")
    number = digits(x)
    n = F.length(number)

    def by_kind(email: Column, ip: Column, card: Column, phone: Column) -> Column:
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)

    host = F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1))
    calling = F.regexp_extract(x, r"^(?:\+|00)([0-9]{1,3})", 1)
    called = one_of([F.array_contains(constant(CALLING), F.left(calling, F.lit(k))) for k in (1, 2, 3)])
    first = F.regexp_extract(x, "^([0-9]+)", 1).cast("int")
    words = F.when(kind == "email", before.rlike(_words(BEFORE["email"])))
    for k in KINDS[1:]:
        words = words.when(kind == k, before.rlike(_words(BEFORE[k])))
    return F.array(
        by_kind(
            _vote(x.contains("@"), x.rlike(r"(?i)\x20at\x20[^\x20]+\.")), _vote(~x.contains("["), F.lit(False)),
            _vote(~x.contains(".")), _vote(x.startswith("+"), ~x.rlike(r"^(?:00|\(|0)")),
        ),
        by_kind(
            _vote((F.length(x) <= 254) & ~x.rlike(r"^[.-]|\.\.|[.-]@")), _vote(F.regexp_replace(x, r"[^0-9]+", ".").rlike(_IP)),
            _vote(luhn(number)), _vote(n.between(8, 15)),
        ),
        by_kind(
            _vote(F.array_contains(constant(HOSTS), host)), _vote(first.between(1, 254) & (first != 127)),
            _vote(number.rlike(ISSUERS)), _vote(called, ~x.rlike(r"^(?:0|\()")),
        ),
        _vote(words, F.lit(False)),
        _vote(F.lit(False), before.rlike(r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(AGAINST) + r")[\x20.:#=\"'-]*$")),
        _vote(~before.rlike(r"[\p{L}\p{N}_=/#-]$") & ~after.rlike(r"^[\p{L}\p{N}_/-]")),
    )


def features() -> Column:
    """Values from 0 to 15 of (kind, x, before, after, votes): the votes, and digits, neighbours, length and separators."""
    x = F.col("x")

    def beside(text: Column, pattern: str) -> Column:
        c = F.regexp_extract(text, pattern, 0)
        return (
            F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"\p{N}"), 3).when(c.isin(".", ",", ";", ":", "!", "?"), 4)
            .when(c.isin("(", ")", "[", "]", "<", ">"), 5).when(c.isin('"', "'", "="), 6).otherwise(7)
        )

    separator = F.when(x.contains("("), 1).when(x.contains(" "), 2).when(x.contains("-"), 3).when(x.contains("."), 4).otherwise(0)
    return F.concat(
        F.transform("votes", lambda v: v + 1),
        F.array(
            F.least(F.length(digits(x)), F.lit(VALUES - 1)), beside(F.col("before"), r"(?s).$"), beside(F.col("after"), r"(?s)^."),
            F.least(F.floor(F.length(x) / 4), F.lit(VALUES - 1)).cast("int"), separator,
        ),
    )


def _odds(prior: list[float], weights: list[list[list[float]]], of: str) -> Column:
    """Log odds of a row by its kind's number ``k`` and the values in ``of``, from constant tables."""
    size = len(weights[0])
    flat = [w for kind in weights for values in kind for w in values]
    width = len(weights[0][0])
    table, start = constant(flat), F.col("k") * F.lit(size * width)
    terms = F.transform(F.col(of), lambda v, i: F.get(table, (start + i * F.lit(width) + v).cast("int")))
    return F.get(constant(prior), F.col("k")) + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-60.0)), F.lit(60.0))))


def _estimate(rows: DataFrame, of: str, size: int, width: int, lean: float) -> tuple[list[float], list[list[list[float]]]]:
    """Log odds of each kind and of each value, from rows (k, n, p, ``of``) weighed by their probability ``p``.

    One row for a kind, place and value comes back, whatever the input. ``lean`` counts so many
    examples for what a vote says (values from 0 to 2 are votes).
    """
    sums = rows.select("k", "n", "p", F.posexplode(of).alias("j", "v")).groupBy("k", "j", "v").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    held = {(r["k"], r["j"], r["v"]): (r["yes"], r["no"]) for r in sums.collect()}
    prior, weights = [], []
    for k in range(len(KINDS)):
        total = [sum(held.get((k, 0, v), (0.0, 0.0))[side] for v in range(width)) + 1.0 for side in (0, 1)]
        prior.append(math.log(total[0] / total[1]))
        table = []
        for j in range(size):
            extra = [(1.0 + lean * (v > 1), 1.0 + lean * (v < 1)) if j < len(LABELERS) else (1.0, 1.0) for v in range(width)]
            yes, no = ([held.get((k, j, v), (0.0, 0.0))[side] + extra[v][side] for v in range(width)] for side in (0, 1))
            table.append([math.log(yes[v] / sum(yes)) - math.log(no[v] / sum(no)) for v in range(width)])
        weights.append(table)
    return prior, weights


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], list[list[list[float]]]]:
    """Expectation-maximisation over the patterns of votes (k, votes, n), which are few whatever the input.

    Starts from the majority. Returns the log odds of each kind, and of each labeler's votes (-1, 0, 1).
    """
    coded = patterns.select("k", "n", F.transform("votes", lambda v: v + 1).alias("coded"), F.aggregate("votes", F.lit(0), lambda a, b: a + b).alias("sum"))
    found = None
    for _ in range(rounds):
        p = _probability(F.col("sum").cast("double")) if found is None else _probability(_odds(*found, "coded"))
        found = _estimate(coded.withColumn("p", p), "coded", len(LABELERS), 3, lean=2.0)
    return found


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id), and (row, k, kind, base, start, end, x, before, after) of all matches of both pattern lists."""
    text = F.coalesce("text", F.lit(""))
    columns = [(k, base, _pieces(text, kind, base).alias(f"{kind}_{base}")) for base in (True, False) for k, kind in enumerate(KINDS)]
    # No text is kept, only what stands around matches; written at once, which settles the row numbers.
    held = materialize(docs.select("doc_id", *(c for _, _, c in columns)).withColumn("row", F.monotonically_increasing_id()))
    lists = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(base).alias("base"), F.col(f"{KINDS[k]}_{base}").alias("items")) for k, base, _ in columns))
    parts = held.select("row", F.explode(F.filter(lists, lambda x: x["items"].isNotNull())).alias("list")).select(
        "row", "list.k", "list.base", F.posexplode("list.items").alias("i", "item")
    )
    order = Window.partitionBy("row", "k", "base").orderBy("i")
    size = F.coalesce(F.length("item.x"), F.lit(0)).cast("long")
    start = F.sum("item.gap").over(order) + F.sum(size).over(order) - size
    found = parts.select(
        "row", "k", constant(list(KINDS))[F.col("k")].alias("kind"), "base", start.alias("start"), (start + size).alias("end"),
        "item.x", "item.before", F.coalesce(F.lead("item.head").over(order), F.lit("")).alias("after"),
    )
    found = found.where(F.col("x").isNotNull()).where(~F.col("base") | is_valid(F.col("kind"), F.col("x")))
    return held.select("row", "doc_id"), materialize(found)


def spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text; others are ignored).

    ``spans`` holds (k, kind, start, end, base, p), by kind as in ``KINDS``, then start, in code
    points. Base spans always stay, with p 1. The others are candidates that the classifier
    gives ``threshold`` or more, that overlap no base span and no candidate before them. NULL
    and empty texts have none. Rows that repeat come back as often as they are there; an empty table gives no rows.
    """
    rows, found = matches(docs)
    candidates = materialize(found.where(~F.col("base")).withColumn("votes", votes()).withColumn("values", features()))
    patterns = materialize(candidates.groupBy("k", "votes").agg(F.count(F.lit(1)).alias("n")))
    believed = _probability(_odds(*reliabilities(patterns), "coded"))
    # Posteriors of the votes are what the classifier of spans learns from, by their other features too.
    taught = candidates.withColumn("coded", F.transform("votes", lambda v: v + 1)).select("k", F.lit(1).alias("n"), "values", believed.alias("p"))
    classifier = _estimate(taught, "values", len(LABELERS) + 5, VALUES, lean=0.0)
    added = candidates.withColumn("p", _probability(_odds(*classifier, "values"))).where(F.col("p") >= threshold)
    named = ["row", "k", "kind", "start", "end", "base"]
    every = found.where("base").select(*named, F.lit(1.0).alias("p")).unionByName(added.select(*named, "p"))
    forward = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    # By falling start, so that no frame is computed anew for each row.
    reach = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(forward) > F.col("start"), F.lit(False))
    later = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(backward) < F.col("end"), F.lit(False))
    free = every.select("*", reach.alias("reach"), later.alias("later")).where(F.col("base") | ~(F.col("reach") | F.col("later")))
    before = Window.partitionBy("row").orderBy("start", "k", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(before) > F.col("start"), F.lit(False))
    kept = free.select("*", covered.alias("covered")).where(F.col("base") | ~F.col("covered"))
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "start", "end", "kind", "base", "p"))).alias("spans"))
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string,base:boolean,p:double>>")
    return rows.join(lists, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
