"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so that words of the same letters in any order have one key and a
letter added, removed or exchanged changes the key by that letter's value or the difference of two values. Words one
edit apart are found by joining keys less one letter's value: equal ones name an exchange, and one that equals a whole
key names an addition or removal. An edit lies in one half of the word, so the other half is part of the join's key: a
word gives a row for each distinct letter of each half and not one for each value of an alphabet, and anagrams of whole
words, frequent as they are, do not meet. The order of letters is verified for every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._spark import stored

#: The shortest word, its least count, how much more frequent a form is, and which words lose a letter (fixed values).
MIN_LENGTH, MIN_COUNT, FORM_FACTOR, LOSES = 7, 2, 10, 31
_RUN = f"([A-Za-zÀ-ÿ]{{{MIN_LENGTH},}})"
#: Keys are sums modulo this prime, so that a word of any length has one.
_MODULUS = 2**61 - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame) -> DataFrame:
    """(word) a row for each run of letters of at least ``MIN_LENGTH`` code points, A-Z lower-cased.

    A run loses the code point at crc32 % length where 31 divides the crc32 of ``<doc_id>:<run>``; a document without id
    has an empty one there. Shorter runs are left out at once, as none can become longer.
    """
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_RUN), 1)
    told = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    told = told.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return told.select(F.when(F.col("h") % LOSES == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the words with at least ``MIN_COUNT`` occurrences over all documents."""
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _value(letter: Column) -> Column:
    """The fifth power of a letter's code point."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: (s + _value(c)) % _MODULUS)


#: Rows of exchanges meet each other, those of a longer word and a shorter one meet where the edit may lie in the same half.
_EXCHANGE, _LONGER, _SHORTER = 0, 1, 3


def _rows(words: DataFrame) -> DataFrame:
    """(key, role, word, n): of the letters of a half each distinct one gives a row; the key has the other half's letters
    in order and the sum of all letters but that one. ``role`` tells halves apart for words of different lengths."""
    base = words.select("word", "n", F.filter(F.split("word", ""), lambda c: c != "").alias("l"))
    base = base.withColumn("size", F.size("l")).withColumn("sum", anagram_key(F.col("l")))
    parts = []
    for role in (_EXCHANGE, _LONGER, _SHORTER):
        length = F.col("size") - 1 if role == _LONGER else F.col("size")  # of the shorter word, which halves are taken of
        half = (length / 2).cast("int")
        for back, alike, edited in ((0, F.substring("word", F.lit(1), half), F.slice("l", half + 1, F.col("size"))), (1, F.substring("word", F.col("size") - (length - half) + 1, length), F.slice("l", F.lit(1), half))):
            row = base.select("word", "n", F.lit(role + back * (role != _EXCHANGE)).alias("role"), F.xxhash64(F.lit(role == _EXCHANGE), F.lit(back), length, alike).alias("alike"), "sum", edited.alias("edited"))
            if role != _SHORTER:
                row = row.withColumn("c", F.explode(F.array_distinct("edited"))).withColumn("sum", F.pmod(F.col("sum") - _value(F.col("c")), F.lit(_MODULUS)))
            parts.append(row.select(F.xxhash64("alike", "sum").alias("key"), "role", "word", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words one inserted, deleted or replaced letter apart.

    Each pair meets once: two words of one length differ in one half, and of a longer and a shorter word the back halves
    count only if the front ones differ.
    """
    rows = _rows(words)
    a, b = (rows.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("role", "word", "n")]) for x in "ab")
    front = ((F.length("a_word") - 1) / 2).cast("int")
    apart = F.substring("a_word", F.lit(1), front) != F.substring("b_word", F.lit(1), front)
    exchange = (F.col("a_role") == _EXCHANGE) & (F.col("b_role") == _EXCHANGE) & (F.col("a_word") < F.col("b_word"))
    longer = ((F.col("a_role") == _LONGER) & (F.col("b_role") == _SHORTER)) | ((F.col("a_role") == _LONGER + 1) & (F.col("b_role") == _SHORTER + 1) & apart)
    met = a.join(b, "key").filter(exchange | longer).filter(F.levenshtein("a_word", "b_word", 1) == 1)
    both = F.array(*[F.struct(*[F.col(f"{x}_{c}").alias(n) for x, names in ((p, ("word", "n")), (q, ("other", "other_n"))) for c, n in zip(("word", "n"), names, strict=True)]) for p, q in ("ab", "ba")])
    return met.select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the end, twice as far each round.

    A form is at least ten times as frequent as its word, so that paths have no cycle and fewer steps than counts have digits.
    """
    hops = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(hops.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-hops")
        hops = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return hops


def variants(docs: DataFrame) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root.

    Defined cases: a null or empty text has no words; an empty table gives no rows; a document without id has the empty
    id; repeated rows count as often as they stand there; of near words of equal n the smallest in code-point order is the
    form; other columns do not matter; a word of any length has a key, and its rows do not grow with it beyond one for
    each distinct letter of a half.
    """
    words = stored(words_of(docs), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("most"))
    is_form = -F.col("most.m") >= FORM_FACTOR * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("most.w")).alias("form"), F.when(is_form, -F.col("most.m")).alias("form_n")
    )
    forms = stored(forms, "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by a table of 256 entries, words as above, pairs by what is left when one letter is taken out.
ORACLE_SQL = """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
  runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
  counted AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS hex FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
  hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex) // 2), lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM counted, t),
  words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
  cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS at_ FROM words), cut AS (SELECT word, n, at_, substr(word, 1, at_ - 1) || substr(word, at_ + 1) AS rest FROM cuts),
  shorter AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN words b ON a.rest = b.word),
  near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.at_ = b.at_ AND a.word <> b.word
    UNION ALL SELECT word, n, other, other_n FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter),
  best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1, 2),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
  walk AS (SELECT word, word AS at_ FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at_ WHERE forms.form IS NOT NULL),
  ends AS (SELECT walk.word, walk.at_ AS root FROM walk JOIN forms ON forms.word = walk.at_ WHERE forms.form IS NULL)
  SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
