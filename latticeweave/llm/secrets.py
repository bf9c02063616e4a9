"""Secret scans with multipart credential linking, in Spark expressions only.

Base kinds are found by pattern: ``assign``, ``access`` and ``hex``. The parts of a credential are then linked: secrets
(``assign`` and ``hex`` spans, and weak candidates), access identifiers (``access`` spans, and ``client_id``-like
assignments) and endpoints (URLs). A weak candidate is a run of 24 or more base64 characters that mixes cases and digits,
also right behind a "=". Alone it says little, so it is reported, as kind ``weak``, only if a complementary part lies in
the same scope, and no base span overlaps it: an interval join of secrets with the parts that end before them and start
at most ``scope`` code points before their start, or start at most ``scope`` behind their end. Each secret is linked with
the nearest identifier and the nearest endpoint; ``links`` lists them.

The join runs over the text's own arrays of parts, so no text or span is shuffled, and each text's links are its own. Its
cost grows with the number of parts: sums run over blocks, and a secret looks only at as many neighbours as fit a scope.

Positions are code points, ends exclusive. They come from splitting a text by the pattern: lengths of the pieces and of
the matches, summed. Defined cases: a null text is empty; texts without parts give an empty array; nothing else of the
row is read. ``redact`` replaces every span, overlaps merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a length in the pattern drops the same runs as a filter afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}+", r"(?<![0-9a-f])[0-9a-f]{32,}+"
IDENTIFIER = r"""(?i)(?:client|account|access|user)_?(?:key_?)?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}+"""
ENDPOINT = r"(?:https?|ftp|s3|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[A-Za-z0-9.-]++"
#: "=" before a run separates, behind it it pads. A run follows no character of its own kind, and looks ahead in itself only.
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}+=*+"
KINDS = ("assign", "access", "hex", "weak")
SPAN = "array<struct<kind:string,start:int,end:int>>"
LINK = "array<struct<kind:string,start:int,end:int,identifier:struct<start:int,end:int>,endpoint:struct<start:int,end:int>>>"
#: Code points in which the parts of one credential lie; values to a run of running sums.
SCOPE, RUN = 256, 256
#: The shortest match of each kind, as its pattern says.
SHORTEST = {"assign": 14, "access": 16, "hex": 32, "weak": 24, "identifier": 11, "endpoint": 6}


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, first: Column, add) -> Column:
    """For each value of an array that is not empty what add() makes of those before it, from `first` on. Runs of RUN
    values, then the runs' own results: the cost doesn't grow with the array's square."""

    def over(runs: Column) -> Column:
        whole = F.transform(runs, lambda r: F.aggregate(r, first, add))
        step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        inside = lambda r, at: F.aggregate(r, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]
        return _let(whole, lambda w: F.flatten(F.transform(runs, lambda r, k: inside(r, F.aggregate(F.slice(w, F.lit(1), k), first, add)))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: F.slice(v, k * RUN + 1, F.lit(RUN)))
    return _let(values, lambda v: _let(cut(v), over))


def _matches(text: Column, pattern: str, kind: str, keep=None, hint: str | None = None) -> Column:
    """Spans of all leftmost matches that don't overlap, of those that keep() takes. hint: what every match holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    length = lambda g, m: F.transform(m, lambda x, i: F.get(g, i) + F.char_length(x))
    span = lambda x, start: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(x)).alias("end"))
    one = lambda x, start: span(x, start) if keep is None else F.when(keep(x), span(x, start))
    add = lambda a, x: a + x
    spans = _let(found, lambda m: _let(gaps, lambda g: _let(_running(length(g, m), F.lit(0), add), lambda at: F.transform(m, lambda x, i: one(x, F.get(at, i) + F.get(g, i))))))
    if keep is not None:
        spans = F.filter(spans, lambda x: x.isNotNull())
    some = text.rlike(pattern) if hint is None else text.contains(hint) & text.rlike(pattern)
    return F.when(some, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _part(span: Column, role: int, at: str) -> Column:
    """A span in the join: role 0 is a secret, 1 an identifier, 2 an endpoint; sorted by its start or end first."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"])
    return F.struct(span[at].alias("at"), F.lit(role).alias("role"), rank.alias("rank"), span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))


def scan(text: Column, scope: int = SCOPE) -> Column:
    """struct<spans, links> of a text: spans by start, then kind as listed; links by their secret's start, then kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # A match's own text matches alone as it does in the text, so the second group is looked up in short strings.
    assign = _matches(text, ASSIGN, "assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    base = F.concat(assign, _matches(text, ACCESS, "access", hint="AKIA"), _matches(text, HEX, "hex"))
    none = F.struct(F.array().cast(SPAN).alias("spans"), F.array().cast(LINK).alias("links"))

    def found(b: Column, w: Column) -> Column:
        links = F.when(F.size(b) + F.size(w) > 0, _links(text, b, w, scope)).otherwise(F.array().cast(LINK))
        weak = lambda k: F.transform(F.filter(k, lambda s: s["kind"] == "weak"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
        keyed = lambda k: F.array_sort(F.transform(F.concat(b, weak(k)), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        spans = lambda k: F.transform(keyed(k), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return _let(links, lambda k: F.struct(spans(k).cast(SPAN).alias("spans"), k.alias("links")))

    out = _let(base, lambda b: _let(_matches(text, WEAK, "weak"), lambda w: found(b, w)))
    return F.coalesce(out, none)


def find_spans(text: Column, scope: int = SCOPE) -> Column:
    """array<struct<kind, start, end>> of a text: base spans and linked weak candidates, by start, then kind as listed."""
    return scan(text, scope)["spans"]


def _links(text: Column, base: Column, weak: Column, scope: int) -> Column:
    """The interval join. Parts stand in two orders, by start for what lies before a secret and with secrets at their
    ends for what lies behind; spans of one kind don't overlap, so only so many parts fit into a scope, and each secret
    looks at that many neighbours. Nothing is compared with everything."""
    width = sum(scope // least + 1 for least in SHORTEST.values())
    secret = lambda s: s["kind"] != "access"
    identifiers = F.concat(F.filter(base, lambda s: s["kind"] == "access"), _matches(text, IDENTIFIER, "identifier"))
    partners = F.concat(F.transform(identifiers, lambda s: _part(s, 1, "start")), F.transform(_matches(text, ENDPOINT, "endpoint", hint="://"), lambda s: _part(s, 2, "start")))
    secrets = F.concat(F.filter(base, secret), weak)
    # The last to end; of those that end together the longest.
    of = lambda found, role: F.array_max(F.transform(F.filter(found, lambda x: x["role"] == role), lambda x: F.struct(x["end"].alias("end"), (-x["start"]).alias("back"), x["start"].alias("start"))))

    def before(p: Column, s: Column, i: Column, ends: Column) -> Column:
        first = F.greatest(i + 1 - width, F.lit(1))
        around = F.filter(F.slice(p, first, i + 1 - first), lambda x: (x["role"] > 0) & (x["end"] <= s["start"]) & (x["start"] >= s["start"] - scope))
        # A weak candidate goes if a base span reaches into it from before, or starts in it: of what starts in a run, only
        # its last few parts are no base spans.
        inside = F.exists(F.slice(p, i + 2, F.lit(4)), lambda x: x["rank"].between(1, 3) & (x["start"] < s["end"]))
        covered = (s["kind"] == "weak") & ((F.get(ends, i) > s["start"]) | inside)
        return _let(around, lambda a: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), covered.alias("covered"), of(a, 1).alias("one"), of(a, 2).alias("two")))

    def behind(s: Column, i: Column, q: Column) -> Column:
        around = F.filter(F.slice(q, i + 2, F.lit(width)), lambda x: (x["role"] > 0) & (x["start"] >= s["end"]) & (x["start"] < s["end"] + scope))
        nearest = lambda a, role: F.array_min(F.transform(F.filter(a, lambda x: x["role"] == role), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return _let(around, lambda a: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), nearest(a, 1).alias("one"), nearest(a, 2).alias("two")))

    real = lambda found: F.array_sort(F.filter(found, lambda x: x.isNotNull()))
    by_start = lambda k: F.array_sort(F.concat(k, F.transform(secrets, lambda s: _part(s, 0, "start"))))
    by_end = lambda k: F.array_sort(F.concat(k, F.transform(secrets, lambda s: _part(s, 0, "end"))))
    base_ends = lambda p: _running(F.transform(p, lambda x: F.when(x["rank"].between(1, 3), x["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    left = lambda k: _let(by_start(k), lambda p: _let(base_ends(p), lambda ends: real(F.transform(p, lambda s, i: F.when(s["role"] == 0, before(p, s, i, ends))))))
    right = lambda k: _let(by_end(k), lambda q: real(F.transform(q, lambda s, i: F.when(s["role"] == 0, behind(s, i, q)))))

    def nearer(s: Column, a: Column, b: Column) -> Column:
        """The partner before or behind, whichever leaves the smaller gap; before, if they are equal."""
        early = a.isNotNull() & (b.isNull() | (s["start"] - a["end"] <= b["start"] - s["end"]))
        return F.when(early, F.struct(a["start"].alias("start"), a["end"].alias("end"))).when(b.isNotNull(), F.struct(b["start"].alias("start"), b["end"].alias("end")))

    both = lambda k: F.zip_with(left(k), right(k), lambda l, r: F.struct(l["kind"].alias("kind"), l["start"].alias("start"), l["end"].alias("end"), l["covered"].alias("covered"), nearer(l, l["one"], r["one"]).alias("identifier"), nearer(l, l["two"], r["two"]).alias("endpoint")))
    linked = lambda found: F.filter(found, lambda x: ~x["covered"] & (x["identifier"].isNotNull() | x["endpoint"].isNotNull()))
    plain = lambda found: F.transform(linked(found), lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "identifier", "endpoint")]))
    return _let(partners, lambda k: F.when(F.size(k) > 0, plain(both(k))).otherwise(F.array().cast(LINK))).cast(LINK)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def joined_links(links: Column) -> Column:
    """kind:start:end>identifier>endpoint, comma-joined; a part that is missing is empty."""
    span = lambda x: F.coalesce(F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")), F.lit(""))
    return F.array_join(F.transform(links, lambda x: F.concat_ws(">", F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")), span(x["identifier"]), span(x["endpoint"]))), ",")


def with_spans(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc, spans, links): doc is a struct of all the input's columns."""
    # Every row is scanned where it is read.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), scan(F.col(f"`{text_col}`"), scope).alias("found"))
    return rows.select("doc", "found.spans", "found.links")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by mark; spans that overlap or touch become one."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, p: F.struct(
            F.greatest(s["at"], p["end"]).alias("at"),
            F.when((p["start"] > s["at"]) | (F.size(s["out"]) == 0), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.greatest(p["start"] - s["at"], F.lit(0))), F.lit(mark)))).otherwise(s["out"]).alias("out"),
        ),
    )
    tail = F.substring(text, merged["at"] + 1, F.lit(2147483647))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(merged["out"], ""), tail)).otherwise(text)
