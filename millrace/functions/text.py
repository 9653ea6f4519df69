"""String expressions with the whitespace rules of Unicode text stripping."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text, beside (?U)\s.
_SPACE = r"[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove Unicode white space and the separators U+001C-U+001F at both ends; null stays null."""
    return F.regexp_replace(_col(c), rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def rstrip(c) -> Column:
    """As ``strip``, at the end only."""
    return F.regexp_replace(_col(c), rf"(?U){_SPACE}+\z", "")


def let(x: Column, body) -> Column:
    """body of x, with x worked out once."""
    return F.element_at(F.transform(F.array(x), body), 1)
