"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (leftmost, non-overlapping per kind): assignments, access identifiers, long
hex runs. A credential is often spread over parts that are weak on their own: an
identifier (client, account, user), a secret-like string, an endpoint (URL). Weak parts
are sought in what the base spans leave. The parts of one text join by interval: parts
whose starts are within `scope` code points are in the same or in neighbouring slices of
that width. A weak identifier is reported only with a secret (weak, assignment or hex) in
scope, a weak secret only with an identifier (weak or access), an endpoint only with both.
Base spans always stay. Per text and slice the join holds the starts of each role, at most
`scope` of them, so a text full of parts gives no pairs; only texts with a weak part take
part in it.

Places come from the texts between matches: code points before the i-th match.

Defined cases: null text counts as empty and has no span; repeated rows are told apart by
their text, equal rows get equal results; a null id is an id; ties of start are ordered
by kind as listed in KINDS; an empty table gives an empty one; other columns stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import keep

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
ASSIGN = (
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so this equals "runs, then 20 or more"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: they may be anything on their own. Names in either case, of ASCII only.
WHO = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
    for name in "client_id client account user username login access_key key_id".split()
)
IDENT = rf"""(?:{WHO})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}}"""
SECRET = r"[A-Za-z0-9+/_-]{16,}"  # whole runs of any length, with a digit and a letter
ENDPOINT = r"(?:https?|jdbc:[a-z]{2,}|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}"


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>>: matches of a pattern with places in code points.

    `value` is the match, or one group of it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(
        F.arrays_zip(found.alias("found"), value.alias("value")), F.split(text, pattern, -1),
        lambda m, between: F.struct(F.char_length(between).alias("gap"), F.char_length(m["found"]).alias("size"), m["value"].alias("value")),
    )
    empty = F.array().cast("array<struct<start:long,end:long,value:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    walked = F.aggregate(
        steps, start,
        lambda acc, m: F.when(m["size"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.array_append(acc["out"], F.struct(
                (acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["size"]).alias("end"), m["value"].alias("value")
            )).alias("out"),
        )),
    )["out"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def masked(text: Column, pattern: str) -> Column:
    """The text with spaces in the place of every match."""
    kept = F.array_join(F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda between, m: F.concat(between, F.repeat(F.lit(" "), F.coalesce(F.char_length(m), F.lit(0)))),
    ), "")
    return F.when(text.rlike(pattern), kept).otherwise(text)


def tagged(spans: Column, kind: str) -> Column:
    place = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
    ))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; spans sorted by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def scan(
    docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text", versions: bool = False
) -> DataFrame:
    """(id, base, linked) of every text, with `versions` also the hash that tells texts of
    one id apart. Spans are (start, kind, end, value), kind being the place in KINDS;
    `linked` are the weak parts that complementary parts confirm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    base = F.concat(tagged(assign, "assign"), tagged(matches(text, ACCESS), "access"), tagged(matches(text, HEX), "hex"))
    rest = F.col("rest")
    secret = F.filter(matches(rest, SECRET), lambda s: (
        s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    ))
    weak = F.concat(tagged(matches(rest, IDENT), "ident"), tagged(secret, "secret"), tagged(matches(rest, ENDPOINT), "endpoint"))
    found = keep(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text, F.char_length(text)).alias("version"),
            base.alias("base"), masked(masked(masked(text, ASSIGN), ACCESS), HEX).alias("rest"),
        ).select("id", "version", "base", weak.alias("weak")),
        "secret-parts",
    )
    parts = (
        found.where(F.size("weak") > 0).select("id", "version", "base", "weak").distinct()
        .select("id", "version", F.explode(F.concat("base", "weak")).alias("part"))
        .select("id", "version", "part.*")
    )
    linked = link(keep(parts, "secret-weak"), scope)
    back = linked.select(F.col("id").alias("l_id"), F.col("version").alias("l_version"), "linked")
    return (
        found.join(back, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("version") == F.col("l_version")), "left")
        .select(
            F.col("id").alias(id_col), *(["version"] if versions else []), "base",
            F.coalesce("linked", F.array().cast("array<struct<start:long,kind:int,end:long,value:string>>")).alias("linked"),
        )
    )


def link(parts: DataFrame, scope: int) -> DataFrame:
    """(id, version, linked): weak parts with complementary parts in scope, by an interval
    join on slices of `scope` code points."""
    role = (
        F.when(F.col("kind").isin(KINDS.index("ident"), KINDS.index("access")), "who")
        .when(F.col("kind") == KINDS.index("endpoint"), "where").otherwise("what")
    )
    key = ["id", "version"]
    placed = parts.withColumn("role", role).withColumn("slice", F.floor(F.col("start") / scope))
    marks = placed.groupBy(*key, "slice").pivot("role", ["who", "what", "where"]).agg(
        F.array_sort(F.collect_set("start"))
    )
    near = marks.select(*key, F.explode(F.array(F.col("slice") - 1, F.col("slice"), F.col("slice") + 1)).alias("slice"), "who", "what", "where")
    merged = near.groupBy(*key, "slice").agg(*[F.flatten(F.collect_list(r)).alias(r) for r in ("who", "what", "where")])
    m = merged.select(F.col("id").alias("m_id"), F.col("version").alias("m_version"), F.col("slice").alias("m_slice"), "who", "what", "where")
    joined = placed.where(F.col("kind") >= 3).join(
        m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("version") == F.col("m_version")) & (F.col("slice") == F.col("m_slice"))
    )
    has = lambda r: F.exists(r, lambda s: F.abs(s - F.col("start")) <= scope)
    ok = (
        F.when(F.col("role") == "who", has("what"))
        .when(F.col("role") == "what", has("who"))
        .otherwise(has("who") & has("what"))
    )
    return joined.where(ok).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value"))).alias("linked")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def redacted(
    docs: DataFrame, scope: int = 200, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with a mark in the place of every span, base or linked; overlapping spans
    give one mark. Other columns stay as they are."""
    spans = keep(
        scan(docs.select(id_col, text_col), scope, id_col, text_col, versions=True)
        .withColumn("spans", F.array_sort(F.concat("base", "linked"))).where(F.size("spans") > 0)
        .select(F.col(id_col).alias("_s_id"), F.col("version").alias("_s_version"), F.col("spans").alias("_s_spans")).distinct(),
        "secret-spans",
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "_s_spans", start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)
            )).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))),
    )
    names = docs.columns
    joined = docs.withColumn("_version", F.xxhash64(text, F.char_length(text))).join(
        spans, F.col(id_col).eqNullSafe(F.col("_s_id")) & (F.col("_version") == F.col("_s_version")), "left"
    )
    return joined.withColumn(text_col, F.when(F.col("_s_spans").isNull(), F.col(text_col)).otherwise(cut)).select(*names)
