"""Benchmark decontamination on template windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.llm.common import settle, text_or_empty

WINDOW = 8
#: Windows that must match on one alignment (13 words in a row), or all windows of a shorter item.
MIN_WINDOWS = 6
#: A window with fewer plain words than this share counts only if its slots have the same values.
PLAIN_SHARE = 0.5
# Signs of the placeholders, and units that may follow a number.
NUMBER, NAME, UNIT = "#", "@", "$"
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yards", "miles", "mg", "g", "kg", "tons", "ounces", "pounds",
    "ml", "l", "litres", "liters", "gallons", "ms", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks",
    "months", "years", "percent", "degrees", "dollars", "cents", "euros", "usd", "eur", "gbp", "hz", "khz", "mhz", "ghz",
    "kb", "mb", "gb", "tb", "w", "kw", "v", "kph", "mph",
)


def template_tokens(text: Column) -> Column:
    """Array of tokens: lower-case words, and slots that start with their type's sign.

    A number with its inner points and commas is one slot. A capitalised word in the middle of a
    sentence is a name; one after a full stop or at a line's start is not. A unit counts after a
    number only. Punctuation separates. Null gives no tokens.
    """
    plain = F.regexp_replace(text, r"[#@$_]", " ")
    joined = F.regexp_replace(plain, r"[.,](?<=\d[.,])(?=\d)", "_")
    names = F.regexp_replace(joined, r"\p{Lu}(?<=[\p{L}\p{N}_,;:]\x20\p{Lu})(?=\p{Ll})", "@$0")
    numbers = F.regexp_replace(names, r"\d(?<![\p{L}\p{N}_]\d)[\d_]*+", "#$0 ")
    units = F.regexp_replace(numbers, r"(#[\d_]++\s++)((?i:" + "|".join(UNITS) + r"))(?![\p{L}\p{N}])", r"$1\$$2")
    return F.array_remove(F.split(F.lower(units), r"[^\p{L}\p{N}_#@$]+"), "")


#: Code points of the signs.
_NAME, _VALUES = ord(NAME), f"({ord(NUMBER)}, {ord(UNIT)})"
_SLOTS = f"({ord(NUMBER)}, {ord(NAME)}, {ord(UNIT)})"


def _last(width: int) -> str:
    """Place of the last window; at least 1, so that short rows, whose windows are dropped, raise no error."""
    return f"greatest(1, size(tokens) - {width - 1})"


def with_hashes(rows: DataFrame, width: int) -> DataFrame:
    """rows (tokens) with the token hashes and places of the windows; they mean nothing for fewer tokens than width.

    h has a sign for every slot; g has names as words; e also has numbers and units as themselves. `named` are
    the places of windows with a name, `dense` those of windows in which more than half the tokens are
    numbers and units. Each array is made in one pass; slots are not looked at window by window.
    """
    last = _last(width)
    spread = f"flatten(transform({{}}, p -> sequence(greatest(1, p - {width - 1}), least(p, {last}))))"
    over = int(width * (1 - PLAIN_SHARE))
    runs = f"filter(transform(sequence(1, size(at_values) - {over}), j -> named_struct('low', at_values[j - 1 + {over}], 'high', at_values[j - 1])), r -> r.low - r.high < {width})"
    where = "filter(transform(tokens, (t, i) -> if({}, i + 1, null)), i -> i is not null)"
    steps = [
        ("h", f"transform(tokens, t -> xxhash64(if(ascii(t) in {_SLOTS}, substring(t, 1, 1), t)))"),
        ("at_names", where.format(f"ascii(t) = {_NAME}")),
        ("at_values", where.format(f"ascii(t) in {_VALUES}")),
        ("g", f"if(size(at_names) = 0, h, transform(tokens, (t, i) -> if(ascii(t) = {_NAME}, xxhash64(substring(t, 2)), h[i])))"),
        ("named", f"array_distinct({spread.format('at_names')})"),
        ("dense", f"if(size(at_values) <= {over}, cast(array() as array<int>), array_distinct(flatten(transform({runs}, r -> sequence(greatest(1, r.low - {width - 1}), least(r.high, {last}))))))"),
        ("e", f"if(size(dense) = 0, g, transform(tokens, (t, i) -> if(ascii(t) in {_VALUES}, xxhash64(t), g[i])))"),
    ]
    for name, sql in steps:
        rows = rows.withColumn(name, F.expr(sql))
    return rows


def _hash(of: str, width: int) -> str:
    """Hash of the window at i; a dense one has its values in it, too."""
    return {"h": f"xxhash64(slice(h, i, {width}))", "g": f"xxhash64(slice(g, i, {width}))", "e": f"xxhash64(slice(g, i, {width}), slice(e, i, {width}))"}[of]


def _window(of: str, width: int, **more: str) -> str:
    fields = {"place": "i", "words": "false" if of == "h" else "true", **more, "hash": _hash(of, width)}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def document_windows(width: int) -> Column:
    """Array of (place, words, hash): every window with its slots' signs; those with a name also with names as
    words, because what is a name hangs on case, white space and position; dense ones with their values."""
    every = f"sequence(1, {_last(width)})"
    parts = [f"transform({places}, i -> {_window(of, width)})" for places, of in ((every, "h"), ("named", "g"), ("dense", "e"))]
    return F.expr(f"if(size(tokens) < {width}, null, concat({', '.join(parts)}))")


def item_windows(width: int) -> Column:
    """Array of (place, words, plain, hash) of an item: windows of mostly slots only with their values."""
    every = f"sequence(1, {_last(width)})"
    mostly = f"size(filter(slice(tokens, i, {width}), t -> ascii(t) in {_SLOTS})) <= {width * (1 - PLAIN_SHARE)}"
    parts = [
        f"transform(filter({every}, i -> {mostly}), i -> {_window('h', width, plain='true')})",
        f"transform(array_except(named, dense), i -> {_window('g', width, plain='true')})",
        f"transform(dense, i -> {_window('e', width, plain='false')})",
    ]
    return F.expr(f"concat({', '.join(parts)})")


def _identity(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash")]


def _plain_words(tokens: str) -> Column:
    """The tokens without signs, as one string."""
    return F.expr(f"array_join(transform({tokens}, t -> if(ascii(t) in {_SLOTS}, substring(t, 2), t)), ' ')")


def whole_lines(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Passages of items with fewer tokens than a window: a whole line or a whole text must have the same tokens."""
    pieces = F.explode(F.array_distinct(F.concat(F.split(F.col(text_col), "\n"), F.array(F.col(text_col)))))
    lines = docs.select(*_identity(id_col, text_col), pieces.alias("line")).select("id", "text_hash", template_tokens(F.col("line")).alias("tokens"))
    lines = lines.where(F.size("tokens").between(1, width - 1)).select("id", "text_hash", _plain_words("tokens").alias("said")).distinct()
    found = lines.join(items.select("item_id", _plain_words("tokens").alias("said")), "said")
    return found.select("id", "text_hash", "item_id", F.lit(0).alias("alignment"), F.lit(1).alias("matched"), F.lit(1).alias("n_windows"), F.lit("exact").alias("kind"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, min_windows: int = MIN_WINDOWS,
) -> DataFrame:
    """(id, text_hash, item_id, alignment, matched, n_windows, kind): passages of items in documents.

    Windows of template tokens are joined by hash with those of the items; where slots prevail, their
    values must be the same. The matches of a document and an item on one alignment (document place
    minus item place) count together. A passage is min_windows with the same values, or all that a
    shorter item has; or min_windows plain ones, or all plain ones that the item has, with any values
    that are consistent: equal item values stand for equal document values and different ones for different
    ones. kind is `reparameterised` if values differ and are consistent, else `exact`. An item with fewer
    tokens than a window is found only as a whole line or text (see whole_lines), one without tokens never.
    Slots are compared for passages only, from the texts of the documents that have any. Null ids, texts and
    empty tables give no passage (a null document id is kept as null); repeated rows count once.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), template_tokens(F.col(item_text_col)).alias("tokens"))
    items = settle(items.where("item_id is not null and size(tokens) > 0").distinct(), "items")
    index = with_hashes(items.where(F.size("tokens") >= width), width).select("item_id", "tokens", item_windows(width).alias("ws"))
    places = "size(array_distinct(transform({}, w -> w.place)))"
    index = index.select("item_id", F.xxhash64("tokens").alias("version"), F.expr(places.format("ws")).alias("n_windows"), F.expr(places.format("filter(ws, w -> w.plain)")).alias("n_plain"), F.explode("ws").alias("w"))
    index = settle(index.select("item_id", "version", "n_windows", "n_plain", F.col("w.place").alias("item_place"), F.col("w.words").alias("item_words"), F.col("w.plain").alias("plain"), F.col("w.hash").alias("hash")), "item-windows")

    source = docs.select(*_identity(id_col, text_col), template_tokens(F.col(text_col)).alias("tokens"))
    windows = with_hashes(source, width).select("id", "text_hash", F.explode(document_windows(width)).alias("w"))
    hits = windows.select("id", "text_hash", F.col("w.place").alias("place"), F.col("w.words").alias("words"), F.col("w.hash").alias("hash")).join(index, "hash")
    match = F.struct("item_place", "item_words", "words", "plain")
    matches = hits.groupBy("id", "text_hash", "item_id", "version", (F.col("place") - F.col("item_place")).alias("alignment"), "n_windows", "n_plain").agg(F.collect_set(match).alias("ms"))
    count = lambda condition: f"size(array_distinct(transform(filter(ms, m -> {condition}), m -> m.item_place)))"
    enough = lambda n, of: f"({n} >= least({min_windows}, {of}))"
    likely = f"{enough(count('true'), 'n_windows')} or (n_plain > 0 and {enough(count('m.plain'), 'n_plain')})"
    likely = settle(matches.where(likely), "passages")

    # the slots of passages, from the tokens of both sides
    wanted = likely.select("id", "text_hash").distinct().withColumnsRenamed({"id": "of", "text_hash": "of_hash"})
    mine = docs.select(*_identity(id_col, text_col), F.col(text_col).alias("text"))
    mine = mine.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left_semi").dropDuplicates(["id", "text_hash"])
    mine = mine.select(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"), template_tokens(F.col("text")).alias("tokens"))
    both = likely.join(mine, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))).drop("of", "of_hash")
    both = both.join(items.select("item_id", F.xxhash64("tokens").alias("version"), F.col("tokens").alias("item_tokens")), ["item_id", "version"])
    slots = lambda tokens, place, words: f"filter(slice({tokens}, {place}, {width}), t -> if({words}, ascii(t) in {_VALUES}, ascii(t) in {_SLOTS}))"
    compared = f"transform(ms, m -> named_struct('item_place', m.item_place, 'plain', m.plain, 'theirs', {slots('item_tokens', 'm.item_place', 'm.item_words')}, 'own', {slots('tokens', 'm.item_place + alignment', 'm.words')}))"
    both = both.select("id", "text_hash", "item_id", "alignment", "n_windows", "n_plain", F.expr(compared).alias("ms"))
    pairs = F.expr("array_distinct(flatten(transform(ms, m -> transform(arrays_zip(m.theirs, m.own), p -> named_struct('item', p.theirs, 'doc', p.own)))))")
    both = both.withColumn("pairs", pairs)
    distinct = lambda side: f"size(array_distinct(transform(pairs, p -> p.{side})))"
    consistent = f"(size(pairs) = {distinct('item')} and size(pairs) = {distinct('doc')})"
    same, bare = enough(count("m.theirs = m.own"), "n_windows"), f"(n_plain > 0 and {enough(count('m.plain'), 'n_plain')})"
    both = both.where(f"{same} or ({bare} and {consistent})")
    kind = F.expr(f"if({consistent} and exists(pairs, p -> p.item <> p.doc), 'reparameterised', 'exact')")
    found = both.select("id", "text_hash", "item_id", "alignment", F.expr(count("true")).alias("matched"), "n_windows", kind.alias("kind"))
    short = items.where(F.size("tokens") < width)
    return found if short.isEmpty() else found.union(whole_lines(docs, short, id_col, text_col, width))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of an item; all columns are kept."""
    key = "concat(coalesce(cast(id as string), '-'), ':', hex(text_hash))"
    found = settle(contaminated(docs, benchmark, id_col, text_col).select(F.expr(key).alias("__identity")).distinct(), "contaminated")
    tagged = docs.withColumn(
        "__identity", F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64(text_or_empty(text_col))))
    )
    return tagged.join(found, "__identity", "left_anti").select(*docs.columns)
