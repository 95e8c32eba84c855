"""Text functions as Column expressions.

Null in, null out, unless a function says otherwise.  Word characters are letters,
digits and the underscore of any script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words of the density's richness term.
DENSITY_STOP = tuple("a above after an are as at be been before being below by can could dare did do does during for from had has have in into is may might must need of on shall should the through to was were will with would 了 是 在 有 和 与 或 等 这 那 的".split())
#: Stop words of query rewriting.
QUERY_STOP = tuple("a an and are at be been being but by can could did do does for had has have how in is may might must of on or shall should that the these this those to was were what when where which who whom whose why will with would".split())
#: Relations by which facts are counted: whole words, and substrings in Chinese.
RELATION_WORDS = tuple("are belongs contains created designed developed discovered founded includes invented is located manufactured produced was were".split())
RELATION_PARTS = ("位于", "创建于", "制造", "包含", "包括", "发明", "发现", "属于", "建立", "开发", "成立于", "是", "有", "生产", "设立", "设计")
WORD = r"[\p{L}\p{N}_]+"
UNITS = "kg|km|m|美元|元|亿|万|秒|分|时|日|月|年"
CONJUNCTIONS = (" and ", " or ", " but ", " however ")
_ASKED = {
    "ner_to_node": ("phrase", "synonymous or relevant phrases that best match this phrase"),
    "query_to_fact": ("question", "relevant triplet facts that matches this question"),
    "query_to_node": ("question", "relevant phrases that are mentioned in this question"),
    "query_to_passage": ("question", "relevant documents that best answer the question"),
    "query_to_sentence": ("question", "relevant sentences that best answer the question"),
}
INSTRUCTIONS = {k: f"Given a {given}, retrieve {wanted}." for k, (given, wanted) in _ASKED.items()}


def plain(c: Column) -> Column:
    """Lower case, with everything but ASCII letters, digits and blanks turned into blanks, trimmed; arrays item by item."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))


def plain_all(c: Column) -> Column:
    return F.transform(c, plain)


def content_id(c: Column, prefix: str) -> Column:
    """Content address: prefix and MD5 of the text."""
    return F.concat(F.lit(prefix), F.md5(c))


def normalised_answer(c: Column) -> Column:
    """Lower case without punctuation, articles and surplus blanks."""
    bare = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def length_score(c: Column) -> Column:
    """1 at 350 characters; less below in proportion, down to 0.5 above; 0 for null."""
    n = F.length(c)
    return F.when(n.isNull() | (n == 0), 0.0).when(n <= 350, n / 350.0).otherwise(F.greatest(F.lit(0.5), 1 - 0.5 * (n - 350) / 650.0))


def entity_count(c: Column) -> Column:
    """Runs of capitalised words, numbers with an optional unit, runs of words in capitals."""
    runs = (r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", rf"(?U)\b\d+(?:\.\d+)?(?:\s*(?:{UNITS}))?\b", r"(?U)\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b")
    return sum((F.regexp_count(c, F.lit(p)) for p in runs[1:]), F.regexp_count(c, F.lit(runs[0])))


def fact_count(c: Column) -> Column:
    """Relation words, whatever their case, and each Chinese relation by itself (they may share characters)."""
    words = F.regexp_count(c, F.lit(r"(?iU)\b(?:" + "|".join(RELATION_WORDS) + r")\b"))
    parts = sum((((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)).cast("int") for p in RELATION_PARTS), F.lit(0))
    return words + F.when(c.rlike(r"\p{IsHan}"), parts).otherwise(0)


def with_density(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``entities``, ``facts``, ``length_score``, ``richness`` and ``density``; each is computed once.

    Richness is 0.6 of the share of words outside the stop list plus 0.4 of the share of distinct words, 0 without words.
    A null text has null counts and density 0."""
    c, low = F.col(text_col), F.lower(F.col(text_col))
    stop = r"(?<![\p{L}\p{N}_])(?:" + "|".join(DENSITY_STOP) + r")(?![\p{L}\p{N}_])"
    staged = df.withColumns({"entities": entity_count(c), "facts": fact_count(c), "length_score": length_score(c), "__words": F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), "__stop": F.regexp_count(low, F.lit(stop))})
    n = F.size("__words")
    rich = F.when(n > 0, F.least(F.lit(1.0), 0.6 * (n - F.col("__stop")) / n + 0.4 * F.size(F.array_distinct("__words")) / n)).otherwise(0.0)
    staged = staged.withColumn("richness", rich).drop("__words", "__stop")
    part = lambda name, by: F.least(F.lit(1.0), F.log1p(F.col(name)) / by)
    total = 0.3 * part("entities", 3.0) + 0.3 * part("facts", 2.5) + 0.2 * F.col("length_score") + 0.2 * F.col("richness")
    return staged.withColumn("density", F.when(c.isNull(), 0.0).otherwise(total))


def density_band(c: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when(c < low, "low").when(c > high, "high").otherwise("medium")


def evidence(similarity: Column, density: Column, query_type: str = "general") -> Column:
    """Product and weighted mean of similarity and density, 3 to 7."""
    ws = {"factual": 0.7, "exploratory": 0.4}.get(query_type, 0.5)
    return 0.3 * similarity * density + 0.7 * (ws * similarity + (1 - ws) * density)


def rewritten(c: Column) -> Column:
    """In lower case without stop words, if at least half of the words remain; else as it was."""
    w = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "")
    kept = F.filter(w, lambda x: ~x.isin(*QUERY_STOP))
    return F.when(F.size(kept) * 2 >= F.size(w), F.array_join(kept, " ")).otherwise(c)


def expanded(c: Column) -> Column:
    """The first one, two and three words, of texts of more than three words; else nothing."""
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array_join(F.slice(w, 1, i), " "))).otherwise(F.array().cast("array<string>"))


def decomposed(c: Column) -> Column:
    """The first three parts, in lower case, around the first of the conjunctions that the text has; else nothing."""
    low = F.lower(c)
    parts = lambda by: F.slice(F.filter(F.transform(F.split(low, by), F.trim), lambda x: x != ""), 1, 3)
    out = F.array().cast("array<string>")
    for by in reversed(CONJUNCTIONS):
        out = F.when(F.contains(low, F.lit(by)), parts(by)).otherwise(out)
    return out


def optimised(c: Column, decompose: bool = True) -> Column:
    """Rewritten (where it differs), expanded and decomposed queries; the query itself if there are none."""
    new = rewritten(c)
    parts = [F.when(new != c, F.array(new)).otherwise(F.array().cast("array<string>")), expanded(c)]
    every = F.concat(*parts, *([decomposed(c)] if decompose else []))
    return F.when(F.size(every) > 0, every).otherwise(F.array(c))


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def parsed_answer(c: Column) -> Column:
    """What follows the first ``Answer:``, up to the next; the text itself without one."""
    return F.when(F.contains(c, F.lit("Answer:")), F.trim(F.split_part(c, F.lit("Answer:"), F.lit(2)))).otherwise(c)


def qa_prompt(question: Column, passages: Column, most: int = 5) -> Column:
    """The first passages, titled, then the question and the call for a thought."""
    shown = F.transform(F.slice(passages, 1, most), lambda p: F.concat(F.lit("Wikipedia Title: "), p, F.lit("\n\n")))
    return F.concat(F.array_join(shown, ""), F.lit("Question: "), question, F.lit("\nThought: "))


def summary(c: Column, most: int = 50) -> Column:
    """The first characters, with dots where there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def embedding_text(c: Column) -> Column:
    """What an embedder is given: one line, a blank for nothing."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    return F.when(one == "", " ").otherwise(one)


def instructed(c: Column, style: str, instruction: Column) -> Column:
    """The instruction before the text, in a model family's form; ``plain`` is instruction and text, ``none`` the text alone."""
    forms = {"gritlm": ("<|user|>\n", "\n<|embed|>\n"), "nvembed": ("Instruct: ", "\nQuery: "), "plain": ("", "")}
    if style not in forms:
        return c
    before, after = forms[style]
    return F.concat(F.lit(before), F.coalesce(instruction, F.lit("")), F.lit(after), c)


def instruction(method: Column, default: str = "query_to_passage") -> Column:
    """The query instruction of a linking method; an unknown one has the default's."""
    known = F.create_map(*(F.lit(x) for pair in INSTRUCTIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, method), F.lit(INSTRUCTIONS[default]))


def cache_key(*cs: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*cs), {"ignoreNullFields": "false"}), 256)


def flag(c: Column) -> Column:
    """Truth of a word: true for yes, y, true, t, 1; false for no, n, false, f, 0; null for anything else."""
    w = F.lower(F.trim(c))
    return F.when(w.isin("yes", "y", "true", "t", "1"), True).when(w.isin("no", "n", "false", "f", "0"), False)


def decoded_escapes(c: Column) -> Column:
    r"""``\uXXXX`` of the basic plane turned into the character."""
    parts = F.split(c, r"\\u(?=[0-9a-fA-F]{4})")
    char = lambda x: F.decode(F.unhex(F.substring(x, 1, 4)), "UTF-16BE")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(char(x), F.substr(x, F.lit(5))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
