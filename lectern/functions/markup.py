"""Markup as a stream of tokens: tags and the texts between them, with the place of each element's end.

Every window has the page's row as its key, and pages are dealt out by it before they are taken apart, so a page's tokens never
move again. Elements are matched by running sums of opening and closing tags of a name; being inside an element is a running
maximum of ends, so no range is joined.
"""
from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lectern.functions.dealing import parts_of
from lectern.functions.text import replaces, tidy

#: Named character references, from the standard library's table.
ENTITIES = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
#: Elements without an end; elements whose content is no markup.
VOID, RAW = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr", "script|style"
#: What a tag holds: quoted attributes may hold any sign.
_INSIDE = r"""[^'">]*+(?:(?:"[^"]*"|'[^']*')[^'">]*+)*+"""
TOKEN = rf"(?is)<!--.*?(?:-->|$)|<({RAW})\b{_INSIDE}>.*?(?:</\1\s*>|$)|</?[a-z]{_INSIDE}>|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<"


def decode_entities(text: Column) -> Column:
    """Character references, named or numbered, as characters; unknown ones stay."""
    parts = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def said(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        known = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")
        return F.when(x.rlike("^&#.+;$"), known).otherwise(F.coalesce(F.try_element_at(names, x), x))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, said), "")).otherwise(text)


def plain(html: str | Column) -> Column:
    """Markup to text: tags out, character references decoded, blanks tidied."""
    return tidy(decode_entities(replaces(html, (r"(?is)<br\s*/?>", " "), (rf"(?s)</?[A-Za-z!?]{_INSIDE}>|</?[A-Za-z!?][^>]*>", ""))))


def rows_sentences(rows: Column) -> Column:
    """The rows of a table (arrays of tidied cells) as sentences: with a header row (several rows and columns, all filled, none a
    number) every cell is announced by its column's name."""
    filled = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))

    def said(rs: Column) -> Column:
        head = F.get(rs, F.lit(0))
        announced = (F.size(rs) > 1) & (F.size(head) > 1) & F.forall(head, lambda c: (c != "") & (F.translate(c, "0123456789.,%$€£- ", "") != ""))
        named = lambda r: F.array_join(F.filter(F.transform(r, lambda c, i: F.when((c != "") & (i < F.size(head)), F.concat_ws(": ", F.get(head, i), c))), lambda c: c.isNotNull()), ". ")
        listed = lambda r: F.array_join(F.filter(r, lambda c: c != ""), ", ")
        stop = lambda x: F.when(F.right(x, F.lit(1)).isin("", ".", "!", "?", "…"), x).otherwise(F.concat(x, F.lit(".")))
        return F.when(announced, F.transform(F.slice(rs, 2, 1 << 20), lambda r: stop(named(r)))).otherwise(F.transform(rs, lambda r: stop(listed(r))))

    return F.filter(F.flatten(F.transform(F.array(filled), said)), lambda s: s != "")  # bound once


def table_sentences(table: Column) -> Column:
    """The rows of a flat table's markup as sentences."""
    inner = lambda x, tag: F.slice(F.split(x, rf"(?i)<{tag}\b[^>]*>"), 2, 1 << 20)
    return rows_sentences(F.transform(inner(table, "tr"), lambda r: F.transform(inner(r, "t[hd]"), plain)))


# --- the stream ------------------------------------------------------------------------------------------------------

def upto(*key: str, last: int = 0) -> WindowSpec:
    """The page's tokens (those of ``key`` in it) up to the token; with ``last`` -1 the ones before it."""
    return Window.partitionBy("_row", *key).orderBy("pos").rowsBetween(Window.unboundedPreceding, last)


def behind() -> WindowSpec:
    """The tokens behind, as what comes before in the other direction."""
    return Window.partitionBy("_row").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)



def named(names: str) -> Column:
    """Whether the tag's name is one of ``names``, which are divided by bars."""
    return F.col("name").isin(*names.split("|"))


def stream(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(_row, _id, pos, tok, name, step, end): a page's tokens in order. name is null for texts, step 1 for an opening and -1 for a
    closing tag (0 for what has no end: texts, comments, scripts, void and self-closing elements); end is the place of the closing
    tag that matches an opening one, null without one. Closing tags without an opening one are passed over."""
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).repartition(parts_of(pages, html_col), "_row")
    t = rows.select("_row", "_id", F.posexplode(F.regexp_extract_all("_html", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    name = F.lower(F.regexp_extract("tok", r"^</?(?:[A-Za-z][\w.-]*:)?([A-Za-z][^\s/>:]*)", 1))
    text = ~F.col("tok").rlike("^<[/A-Za-z!?]")
    t = t.withColumn("name", F.when(text, None).otherwise(name))
    single = F.col("name").isNull() | (F.col("name") == "") | named(VOID) | named(RAW) | F.col("tok").endswith("/>")
    t = t.withColumn("step", F.when(single, 0).when(F.col("tok").startswith("</"), -1).otherwise(1))
    own = Window.partitionBy("_row", "name").orderBy("pos")
    t = t.withColumn("_sum", F.sum("step").over(own))
    floor = F.least(F.lit(0), F.coalesce(F.min("_sum").over(upto("name", last=-1)), F.lit(0)))
    t = t.withColumn("_floor", floor)
    level = F.when(F.col("step") == 1, F.col("_sum") - F.col("_floor")).when((F.col("step") == -1) & (F.col("_sum") >= F.col("_floor")), F.col("_sum") - F.col("_floor") + 1)
    t = t.withColumn("_level", level)
    same = Window.partitionBy("_row", "name", "_level").orderBy("pos")
    end = F.when((F.col("step") == 1) & (F.lead("step").over(same) == -1), F.lead("pos").over(same))
    return t.withColumn("end", end).drop("_sum", "_floor", "_level")


def closed_at(blocks: Column) -> Column:
    """The end of an opening tag: its own, or where that is missing (and for paragraphs, which can't hold blocks, in any case) the
    next tag of a block."""
    following = F.last(F.when(blocks & (F.col("step") != 0), F.col("pos")), ignorenulls=True).over(behind())
    end = F.when(F.col("name") == "p", following).otherwise(F.coalesce("end", following))
    return F.when(F.col("step") == 1, F.coalesce(end, F.lit(1 << 30)))


def covered(starts: Column, end: Column) -> Column:
    """Whether a token lies in one of the elements that ``starts`` marks, their tags included."""
    return F.coalesce(F.max(F.when(starts & (F.col("step") == 1), end)).over(upto()) >= F.col("pos"), F.lit(False))


def text_of(pieces: Column) -> Column:
    """Structs (pos, piece) joined in order and tidied."""
    return tidy(F.array_join(F.transform(F.array_sort(pieces), lambda p: p["piece"]), ""))


def pieces(t: DataFrame) -> DataFrame:
    """``piece``: a text's words, a blank for a line break, null for other tags."""
    text = F.when(F.col("name").isNull(), decode_entities(F.col("tok"))).when(F.col("name") == "br", " ")
    return t.withColumn("piece", text)
