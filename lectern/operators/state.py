"""Reading state from event logs: positions, flags, highlights, the library, settings and voices."""
from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import SPEEDS, nearest_speed
from lectern.operators.timeline import asof


def register_documents(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by doc_id. library/incoming(doc_id, title, kind, text_hash, opened, position, bookmarks): an entry's position and
    bookmarks survive only with an unchanged text."""
    old, new = library.alias("o"), incoming.alias("n")
    both = old.join(new, F.col("o.doc_id") == F.col("n.doc_id"), "full_outer")
    same = F.coalesce(F.col("o.text_hash") == F.col("n.text_hash"), F.lit(False)) | F.col("n.doc_id").isNull()
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select(
        pick("doc_id"), pick("title"), pick("kind"), pick("text_hash"), F.greatest("o.opened", "n.opened").alias("opened"),
        F.when(same, F.col("o.position")).otherwise(F.lit(0)).cast("long").alias("position"),
        F.when(same, F.col("o.bookmarks")).otherwise(F.array().cast("array<bigint>")).alias("bookmarks"))


def latest_positions(moves: DataFrame) -> DataFrame:
    """(user_id, doc) -> position, speed and time of the last move (ties by event_id). Partial aggregation, no sort."""
    last = F.max_by(F.struct(F.col("k").alias("position"), nearest_speed("speed_raw").alias("speed"), "ts"), F.struct("ts", "event_id"))
    return moves.groupBy("user_id", "doc").agg(last.alias("_l")).select("user_id", "doc", "_l.position", "_l.speed", "_l.ts")


def touch(library: DataFrame, opens: DataFrame) -> DataFrame:
    """library(user_id, doc, opened) with the latest of opened and the open events' times."""
    last = opens.groupBy("user_id", "doc").agg(F.max("ts").alias("_t"))
    return library.join(last, ["user_id", "doc"], "left").withColumn("opened", F.greatest("opened", "_t")).drop("_t")


def list_library(library: DataFrame, kind: str, most: int = 14) -> DataFrame:
    """The most recent entries of a kind, newest first, with a label. A top-k: the limit is the feature."""
    rows = library.where(F.col("kind") == kind).orderBy(F.col("opened").desc_nulls_last(), "user_id", "doc").limit(most)
    return rows.select("user_id", "doc", "opened", F.concat_ws(" · ", F.concat(F.lit("Document "), F.col("doc").cast("string")), F.date_format("opened", "yyyy-MM-dd")).alias("label"))


def prune_library(library: DataFrame, keep: int = 300) -> DataFrame:
    """Per reader the ``keep`` most recently opened entries; never opened counts as oldest."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("opened").desc_nulls_last(), "doc"))
    return library.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r")


def remove_documents(library: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return library.join(ids, keys, "left_anti")


def toggle_state(toggles: DataFrame, keys: list[str], item: str = "k") -> DataFrame:
    """keys -> sorted array of the items toggled an odd number of times. Counts combine before the shuffle."""
    odd = toggles.groupBy(*keys, item).agg(F.count("*").alias("_n")).where("_n % 2 = 1")
    return odd.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))


def ignore_state(ignores: DataFrame, resets: DataFrame) -> DataFrame:
    """(doc, k) ignored after the document's last "un-ignore all"."""
    last = resets.groupBy("doc").agg(F.max(F.struct("ts", "event_id")).alias("_reset"))
    rows = ignores.join(last, "doc", "left").where(F.col("_reset").isNull() | (F.struct("ts", "event_id") > F.col("_reset")))
    return rows.select("doc", "k").distinct()


def valid_flags(flags: DataFrame, sizes: DataFrame) -> DataFrame:
    """flags(doc, k) within the document's paragraphs; sizes(doc, n)."""
    return flags.join(sizes, "doc").where("k >= 0 and k < n").select(flags.columns)


def normal_ranges(adds: DataFrame) -> DataFrame:
    """Highlight adds with start <= end, clipped to text_length, without empty or negative ones."""
    a = adds.withColumn("_s", F.least("start", "end")).withColumn("_e", F.greatest("start", "end"))
    a = a.withColumn("_e", F.when(F.col("text_length").isNotNull(), F.least("_e", "text_length")).otherwise(F.col("_e")))
    return a.withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_s", "_e").where("start >= 0 and end > start")


def _level(n: Column) -> Column:
    """Bits of a number above its lowest one."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def overlay_highlights(adds: DataFrame, keys: list[str]) -> DataFrame:
    """The later of overlapping highlights wins: keys, start, end, colour, seq of the add that shows.

    An add is cut into dyadic blocks (level, number), at most two of each level, and a block keeps its newest add. Between
    neighbouring boundaries the newest of the blocks around shows; pieces of one add that touch are joined again. So adds and
    boundaries meet by equality, a boundary meets one block of a level, and a paragraph of n adds costs n times the bits of its
    length, however much they overlap."""
    a = normal_ranges(adds)
    cut = a.select(*keys, "start", "end", F.struct("seq", "colour").alias("_add"), F.explode(F.sequence(F.lit(0), _level(F.col("end")))).alias("level"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    low, high = F.call_function("div", F.col("start") + size - 1, size), F.call_function("div", F.col("end"), size)
    ends = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
    blocks = cut.select(*keys, "level", "_add", F.explode(F.array_compact(ends)).alias("block"))
    blocks = blocks.groupBy(*keys, "level", "block").agg(F.max_by("_add", "_add.seq").alias("_add"))
    points = a.select(*keys, F.explode(F.array("start", "end")).alias("p")).distinct()
    top = _level(F.max("p").over(Window.partitionBy(*keys)))
    bits = points.withColumn("q", F.lead("p").over(Window.partitionBy(*keys).orderBy("p"))).withColumn("_top", top).where("q is not null")
    around = bits.select(*keys, "p", "q", F.explode(F.sequence(F.lit(0), "_top")).alias("level")).withColumn("block", F.call_function("div", F.col("p"), size))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col("x.level") == F.col("y.level"), F.col("x.block") == F.col("y.block")]
    shown = around.alias("x").join(blocks.alias("y"), same).groupBy(*[F.col(f"x.{k}").alias(k) for k in keys], "x.p", "x.q").agg(F.max_by("y._add", "y._add.seq").alias("_t"))
    shown = shown.select(*keys, "p", "q", "_t.seq", "_t.colour")
    order = Window.partitionBy(*keys).orderBy("p")
    fresh = ~((F.lag("seq").over(order) == F.col("seq")) & (F.lag("q").over(order) == F.col("p")))
    runs = shown.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min("p").alias("start"), F.max("q").alias("end"), F.first("colour").alias("colour"), F.first("seq").alias("seq")).drop("_run")


HIGHLIGHT = "user_id long, doc long, para long, id long, start long, end long, colour string"
EVENT = ["op", "start", "end", "colour", "target"]


class Marks:
    """One paragraph's highlights while a log is played: disjoint, found by their starts or their ids. An event costs the highlights
    it touches and a search, whatever their number."""

    def __init__(self, items=(), next_id: int = 1):
        self.at = {start: (i, end, colour) for i, start, end, colour in items}
        self.starts = sorted(self.at)
        self.where = {i: start for start, (i, _, _) in self.at.items()}
        self.next_id = next_id

    def _fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, start: int, end: int, colour: str) -> None:
        start, end = min(start, end), max(start, end)
        if start < 0 or end <= start:
            return
        first = bisect_right(self.starts, start) - 1
        if first < 0 or self.at[self.starts[first]][1] <= start:
            first += 1
        last = max(first, bisect_left(self.starts, end))
        left = right = None
        for s in self.starts[first:last]:
            i, t, c = self.at.pop(s)
            del self.where[i]
            if s < start:
                left = (s, i, start, c)
            if t > end:  # what stays behind a split is a new highlight
                right = (end, self._fresh() if s < start else i, t, c)
        pieces = [p for p in (left, (start, self._fresh(), end, colour), right) if p]
        self.starts[first:last] = [p[0] for p in pieces]
        for s, i, t, c in pieces:
            self.at[s], self.where[i] = (i, t, c), s

    def play(self, op: str, start, end, colour, target) -> None:
        if op == "add":
            self.add(int(start), int(end), colour)
        elif op == "clear":
            self.at, self.starts, self.where = {}, [], {}
        elif op == "remove" and target in self.where:
            s = self.where.pop(target)
            del self.at[s]
            del self.starts[bisect_left(self.starts, s)]
        elif op == "recolour" and target in self.where:
            i, t, _ = self.at[self.where[target]]
            self.at[self.where[target]] = (i, t, colour)
        elif op == "have":  # a highlight from before
            self.at[int(start)], self.where[int(target)] = (int(target), int(end), colour), int(start)
            insort(self.starts, int(start))
        elif op == "next":
            self.next_id = int(target)

    def items(self) -> list[tuple]:
        """(id, start, end, colour) in order."""
        return [(self.at[s][0], s, *self.at[s][1:]) for s in self.starts]


def _paragraphs(batches):
    """Task: events by paragraph and number, in any batches -> lists of (key, marks) of the paragraphs that end in each batch. Only a
    paragraph's highlights are held."""
    def whole(x):
        return None if pd.isna(x) else int(x)

    key, marks, done = None, Marks(), []
    for pdf in batches:
        for user, doc, para, *event in pdf[["user_id", "doc", "para", *EVENT]].itertuples(index=False):
            now = (whole(user), whole(doc), whole(para))
            if now != key:
                done += [(key, marks)] if key else []
                key, marks = now, Marks()
            marks.play(*event)
        yield done
        done = []
    yield [(key, marks)] if key else []


def _play(batches):
    """Task: events -> highlights of each paragraph."""
    names = ["user_id", "doc", "para", "id", "start", "end", "colour"]
    for done in _paragraphs(batches):
        rows = [(*key, *x) for key, marks in done for x in marks.items()]
        yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[:-1]})


def _play_paragraphs(batches):
    """Task: events -> a row for each paragraph, with the number that its next highlight gets."""
    names = ["user_id", "doc", "para", "next", "items"]
    for done in _paragraphs(batches):
        rows = [(*key, marks.next_id, [dict(zip(("id", "start", "end", "colour"), x, strict=True)) for x in marks.items()]) for key, marks in done]
        yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[:-1]})


def _by_paragraph(log: DataFrame, before: DataFrame | None) -> DataFrame:
    """The events of each paragraph in one task and in order, behind rows that bring what was there."""
    key = ["user_id", "doc", "para"]
    events = log.select(*key, "seq", *EVENT)
    if before is not None:
        touched = before.join(log.select(*key).distinct(), key, "left_semi")
        item = touched.select(*key, F.explode("items").alias("i"))
        none = lambda kind: F.lit(None).cast(kind)
        events = events.unionByName(item.select(*key, none("long").alias("seq"), F.lit("have").alias("op"), "i.start", "i.end", "i.colour", F.col("i.id").alias("target")))
        events = events.unionByName(touched.select(*key, none("long").alias("seq"), F.lit("next").alias("op"), none("long").alias("start"), none("long").alias("end"),
                                                   none("string").alias("colour"), F.col("next").alias("target")))
    return events.repartition(*key).sortWithinPartitions(*key, F.col("seq").asc_nulls_first())


def apply_highlight_log(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """log(user_id, doc, para, seq, op, start, end, colour, target) -> current highlights. Ids count up within a paragraph; a split
    leaves the id with its head. ``before``(user_id, doc, para, next, items array<struct<id, start, end, colour>>): what was there.

    Which id an event means depends on all before it, so a paragraph's log is a sequence by nature: paragraphs are dealt over the
    tasks and sorted, and a task reads its events in small batches with one paragraph's highlights in memory."""
    return _by_paragraph(log, before).mapInPandas(_play, HIGHLIGHT)


def play_highlight_log(log: DataFrame, before: DataFrame) -> DataFrame:
    """``apply_highlight_log`` as rows like those of ``before``, one for each paragraph of the log, also where nothing is left."""
    return _by_paragraph(log, before).mapInPandas(_play_paragraphs, before.schema)


def highlights_at(probes: DataFrame, highlights: DataFrame, keys: list[str]) -> DataFrame:
    """probes(keys, char) with the highlight there; highlights are disjoint within their keys, so the last that starts is looked up."""
    rows = highlights.select(*keys, "start", F.col("end").alias("_end"), F.col("start").alias("_start"), F.col("colour").alias("_colour"))
    found = asof(probes, rows, keys, "char", "start", ["_start", "_end", "_colour"])
    there = F.col("char") < F.col("_end")
    return found.select(*probes.columns, F.when(there, F.col("_start")).alias("start"), F.when(there, F.col("_colour")).alias("colour"))


def guard_by_text_hash(highlights: DataFrame, docs: DataFrame) -> DataFrame:
    """Only annotations made on the text as it is now, without empty ranges."""
    return highlights.join(docs.select("doc", "text_hash"), ["doc", "text_hash"], "left_semi").where("start >= 0 and end > start")


def import_legacy_flags(flags: DataFrame, lengths: DataFrame, highlights: DataFrame, colour: str = "yellow") -> DataFrame:
    """Whole-paragraph flags (doc, para) as ranges over the paragraph, unless it is empty or has highlights already."""
    rows = flags.distinct().join(lengths, ["doc", "para"]).where("length > 0").join(highlights.select("doc", "para"), ["doc", "para"], "left_anti")
    return rows.select("doc", "para", F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("end"), F.lit(colour).alias("colour"))


#: Settings with their defaults, limits of numbers, choices of words, names that moved, and the old default of a
#: font size, which counts as none.
DEFAULTS = {
    "theme": "dark", "voice": "af_heart", "device": "CPU", "ocr_engine": "auto", "ocr_lang": "en", "internet_usage": "false", "precache_speeds": "[1.0]",
    "cache_limit_mb": "5120", "read_math": "true", "ocr_smart": "false", "ocr_quality": "standard", "pdf.headings": "true", "pdf.footnotes": "false",
    "pdf.furniture": "false", "pdf.show_pictures": "true", "pdf.read_images": "false", "pdf.tables": "true", "pdf.verses": "auto", "profile.name": "",
    "profile.avatar_color": "#6366F1", "profile.avatar_image": "", "profile.onboarded": "false", "playback.volume": "100", "playback.speed": "1.0",
    "reader.font_family": "Georgia", "reader.font_size": "18", "reader.line_spacing": "1.65", "reader.highlight_sentence": "true", "reader.highlight_word": "true"}
LIMITS = {"playback.volume": (0, 100), "reader.font_size": (12, 28), "reader.line_spacing": (1.2, 2.0), "cache_limit_mb": (0, 1 << 40)}
CHOICES = {
    "theme": ("dark", "light"), "device": ("CPU", "GPU"), "ocr_engine": ("auto", "ocr"), "ocr_quality": ("standard", "sharp"), "pdf.verses": ("auto", "always", "never")}
LEGACY, OLD_FONT_SIZE = {"speed": "playback.speed", "font_size": "reader.font_size"}, "17"


def _literal_map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def flatten_settings(settings: DataFrame) -> DataFrame:
    """settings(user_id, json) -> (user_id, key, value) of every setting: groups to dotted keys, legacy names moved unless the new
    one is there, unknown keys dropped, missing ones filled, numbers clamped, words and switches checked, renamed voices
    replaced, speeds snapped to the catalogue."""
    groups = sorted({k.split(".")[0] for k in DEFAULTS if "." in k})
    top = settings.select("user_id", F.explode(F.from_json("json", "map<string,string>")).alias("key", "value"))
    nested = top.where(F.col("key").isin(*groups)).select("user_id", F.col("key").alias("g"), F.explode(F.from_json("value", "map<string,string>")).alias("k", "value"))
    nested = nested.select("user_id", F.concat_ws(".", "g", "k").alias("key"), "value", F.lit(0).alias("old"))
    flat = top.where(~F.col("key").isin(*groups, *LEGACY)).select("user_id", "key", "value", F.lit(0).alias("old"))
    legacy = top.where(F.col("key").isin(*LEGACY) & ~((F.col("key") == "font_size") & (F.col("value") == OLD_FONT_SIZE)))
    legacy = legacy.select("user_id", F.try_element_at(_literal_map(LEGACY), F.col("key")).alias("key"), "value", F.lit(1).alias("old"))
    given = nested.unionByName(flat).unionByName(legacy).groupBy("user_id", "key").agg(F.min_by("value", "old").alias("value"))
    wanted = settings.select("user_id").distinct().select("user_id", F.explode(_literal_map(DEFAULTS)).alias("key", "default"))
    rows = wanted.join(given, ["user_id", "key"], "left").withColumn("value", F.coalesce("value", "default"))
    key, number = F.col("key"), F.expr("try_cast(value as double)")
    value = F.col("value")
    for name, (lo, hi) in LIMITS.items():
        held = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), number))
        value = F.when(key == name, held.cast("string" if isinstance(lo, float) else "long").cast("string")).otherwise(value)
    for name, words in CHOICES.items():
        value = F.when(key == name, F.when(F.col("value").isin(*words), F.col("value"))).otherwise(value)
    switches = [k for k, v in DEFAULTS.items() if v in ("true", "false")]
    value = F.when(key.isin(*switches), F.expr("try_cast(value as boolean)").cast("string")).otherwise(value)
    value = F.when(key == "playback.speed", nearest_speed(number).cast("string")).otherwise(value)
    value = F.when(key == "voice", F.coalesce(F.try_element_at(_literal_map(RENAMED), F.col("value")), F.col("value"))).otherwise(value)
    chosen = F.array_sort(F.array_distinct(F.filter(F.transform(F.from_json("value", "array<string>"), lambda s: s.try_cast("double")), lambda s: s.isin(*SPEEDS))))
    value = F.when(key == "precache_speeds", F.to_json(chosen)).otherwise(value)
    return rows.select("user_id", "key", F.coalesce(value, "default").alias("value"))


def clean_speeds(chosen: DataFrame) -> DataFrame:
    """chosen(user_id, speeds array<string>) -> sorted array of the catalogue speeds in it, each once."""
    number = F.transform("speeds", lambda s: s.try_cast("double"))
    return chosen.select("user_id", F.array_sort(F.array_distinct(F.filter(number, lambda s: s.isin(*SPEEDS)))).alias("speeds"))


#: The preset voices of each language, the region of an id's first letter, ids that were renamed, the mark of an
#: imported voice pack, and the language of voices that aren't known.
VOICES = {
    "en-us": ("af_heart", "af_bella", "af_nicole", "af_sarah", "af_sky", "am_adam", "am_michael", "am_puck"), "en-gb": ("bf_emma", "bf_isabella", "bm_george", "bm_lewis"),
    "es": ("ef_dora", "em_alex"), "fr-fr": ("ff_siwis",), "it": ("if_sara", "im_nicola"), "pt": ("pf_dora", "pm_alex"), "ja": ("jf_alpha", "jm_kumo"),
    "zh": ("zf_001", "zf_002", "zf_003", "zf_004", "zm_009", "zm_010", "zm_011", "zm_012")}
REGIONS = {"a": "US", "b": "UK", "e": "ES", "f": "FR", "i": "IT", "p": "PT", "j": "JP", "z": "ZH"}
RENAMED, PACK, UNKNOWN = {"zf_xiaobei": "zf_001", "zm_yunxi": "zm_009"}, "pack:", "en-us"


def _lookup(of: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key)


def _titled(name: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def voice_dimension(spark: SparkSession) -> DataFrame:
    """(voice, label, language, region, gender) of the preset voices."""
    rows = spark.createDataFrame([(v, lang) for lang, own in VOICES.items() for v in own], "voice string, language string")
    return rows.select("voice", *_described(F.col("voice"), F.col("language")))


def _described(voice: Column, language: Column) -> list[Column]:
    region = F.coalesce(_lookup(REGIONS, F.left(voice, F.lit(1))), F.lit(""))
    gender = F.when(F.substring(voice, 2, 1) == "f", "female").otherwise("male")
    name = F.when(F.instr(voice, "_") > 0, F.substring(voice, F.instr(voice, "_") + 1, F.length(voice))).otherwise(voice)
    label = F.concat(_titled(name), F.lit(" · "), region, F.lit(" "), gender)
    return [label.alias("label"), language.alias("language"), region.alias("region"), gender.alias("gender")]


def resolve_voices(requests: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """requests(request_id, voice) -> (request_id, voice, label, language, region, gender). Renamed ids are replaced; the language is
    that of the preset, of the pack in packs(name, lang) for an imported one, else the one for unknown voices. Packs have neither
    region nor gender."""
    languages = {v: lang for lang, own in VOICES.items() for v in own}
    rows = requests.select("request_id", F.coalesce(_lookup(RENAMED, F.col("voice")), F.col("voice")).alias("voice"))
    preset = rows.where(~F.col("voice").startswith(PACK) | F.col("voice").isNull())
    preset = preset.select("request_id", "voice", *_described(F.col("voice"), F.coalesce(_lookup(languages, F.col("voice")), F.lit(UNKNOWN))))
    name = F.substring("voice", len(PACK) + 1, 1 << 30)
    own = rows.where(F.col("voice").startswith(PACK)).withColumn("_name", name)
    own = own.withColumn("_lang", F.lit(None).cast("string")) if packs is None else own.join(packs.select(F.col("name").alias("_name"), F.col("lang").alias("_lang")), "_name", "left")
    none = F.lit(None).cast("string")
    return preset.unionByName(own.select("request_id", "voice", F.concat("_name", F.lit(" (voice pack)")).alias("label"), F.coalesce("_lang", F.lit(UNKNOWN)).alias("language"),
                                         none.alias("region"), none.alias("gender")))


def blend_recipes(recipes: DataFrame) -> DataFrame:
    """recipes(recipe_id, recipe "a:60,b:40") -> (recipe_id, voice, weight): shares of the valid positive parts."""
    parts = recipes.select("recipe_id", F.explode(F.split("recipe", ",")).alias("part"))
    parts = parts.select("recipe_id", F.trim(F.split("part", ":")[0]).alias("voice"), F.expr("try_cast(trim(try_element_at(split(part, ':'), 2)) as double)").alias("w"))
    parts = parts.where("voice rlike '^[a-z]{2}_[a-z0-9]+$' and w > 0").groupBy("recipe_id", "voice").agg(F.sum("w").alias("w"))
    return parts.select("recipe_id", "voice", (F.col("w") / F.sum("w").over(Window.partitionBy("recipe_id"))).alias("weight"))


def valid_packs(packs: DataFrame, floats: int = 511 * 256) -> DataFrame:
    """packs(voice, style array<float>) whose vector has the right size and only finite numbers."""
    return packs.where((F.size("style") == floats) & F.forall("style", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
