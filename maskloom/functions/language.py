"""Language of a text by its letters and stop words, as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sample, the weight of a German letter, the stop words.
SAMPLE, LETTER_WEIGHT = 4096, 3
DE_STOP = "der die das den dem des und ist ein eine einer einem nicht ich sich wir sie er war wurde hatte haben hat durch über ohne noch schon sehr vom zum zur beim im am auch sind wenn wird würde auf für von bei nach aus bis mit als dass weil aber oder doch".split()
EN_STOP = "the of to and is for with on at by an be this that are were has have had from or but not will would should could their they there which what where you your our we my his her its been being do does did can may might must if".split()


def detect_language(text: Column) -> Column:
    """de, en or the empty string; of the first 4096 code points."""
    sample = F.left(F.coalesce(text, F.lit("")), F.lit(SAMPLE))
    words = F.split(F.lower(sample), r"\P{L}+")
    count = lambda stop: F.size(F.filter(words, lambda w: w.isin(*stop)))
    de = count(DE_STOP) + LETTER_WEIGHT * F.regexp_count(sample, F.lit("[äöüßÄÖÜ]"))
    en = count(EN_STOP)
    return F.when(de > en, "de").when(en > de, "en").otherwise("")
