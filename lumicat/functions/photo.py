"""Text and metadata functions of the catalog, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fixed(x: Column, digits: int) -> Column:
    """printf-style fixed digits: ties go to the even digit, unlike format_string's."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def aperture_text(aperture: Column | str) -> Column:
    return _fixed(col(aperture), 1)


def shutter_text(shutter: Column | str) -> Column:
    """``1/N`` up to half a second, whole seconds without a fraction, else one digit; 0 and less give 0."""
    s = col(shutter)
    inverse = F.concat(F.lit("1/"), F.bround(F.lit(1.0) / s, 0).cast("bigint").cast("string"))
    return F.when(s <= 0, F.lit("0")).when(s <= 0.5, inverse).when(s == F.floor(s), s.cast("bigint").cast("string")).otherwise(_fixed(s, 1))


def shutter_seconds(text: Column | str) -> Column:
    """The inverse: fractions divide, a zero denominator and unreadable text give 0."""
    t = col(text)
    top, below = F.try_to_number(F.split_part(t, F.lit("/"), F.lit(1)), F.lit("999999.999")), F.split_part(t, F.lit("/"), F.lit(2))
    top = F.expr("1.0D") * F.coalesce(top.cast("double"), F.lit(0.0))
    divisor = F.coalesce(F.try_to_number(below, F.lit("999999.999")).cast("double"), F.lit(0.0))
    return F.when(t.contains("/"), F.coalesce(F.try_divide(top, divisor), F.lit(0.0))).otherwise(top)


def expcomp_text(expcomp: Column | str, mask_zero: bool = False) -> Column:
    x = col(expcomp)
    text = _fixed(x, 2)
    return F.when(text.isin("0.00", "-0.00"), F.lit("")).otherwise(text) if mask_zero else text


def extension(path: Column | str) -> Column:
    """Text after the last dot of the base name, case kept; none if white space follows that dot."""
    return F.regexp_extract(col(path), r"\.([^./\\\s]*)$", 1)


def without_extension(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\.[^./\\\s]*$", "")


def file_type(path: Column | str) -> Column:
    """Lower-cased text after the last dot of the whole path; the whole path if there is none."""
    return F.lower(F.substring_index(col(path), ".", -1))


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def cache_key(path: Column | str, size: Column | str) -> Column:
    return F.md5(F.concat(col(path), col(size).cast("string")))


def sidecar_path(path: Column | str, replace_extension: bool = False) -> Column:
    p = without_extension(path) if replace_extension else col(path)
    return F.concat(p, F.lit(".xmp"))


def exif_line(fnumber, shutter, iso, focal, expcomp) -> Column:
    """``f/A Ss ISOn Fmm``, with the compensation unless it is zero."""
    comp = expcomp_text(expcomp, mask_zero=True)
    line = F.concat(F.lit("f/"), aperture_text(fnumber), F.lit(" "), shutter_text(shutter), F.lit("s ISO"), col(iso).cast("string"), F.lit(" "), _fixed(col(focal), 2), F.lit("mm"))
    return F.when(comp == "", line).otherwise(F.concat(line, F.lit(" "), comp, F.lit("EV")))


def date_line(ts: Column | str) -> Column:
    """Day, month and year unpadded, then hours unpadded with minutes and seconds."""
    return F.date_format(col(ts), "yyyy-M-d H:mm:ss")


def text_match(wanted: Column, value: Column, enabled: Column) -> Column:
    """A rule term: off matches all; ``re:`` is a case-insensitive search; else equality without case."""
    pattern = F.concat(F.lit("(?i)"), F.substring(wanted, 4, 1 << 20))
    return F.when(~enabled, F.lit(True)).when(F.startswith(wanted, F.lit("re:")), F.rlike(value, pattern)).otherwise(F.lower(wanted) == F.lower(value))


def clut_parts(path: Column | str, spaces: tuple[str, ...] = ("sRGB", "AdobeRGB", "ProPhoto", "WideGamut", "BestRGB", "BetaRGB", "BruceRGB", "ACESp0", "ACESp1", "Rec2020")) -> tuple[Column, Column, Column]:
    """Name, extension and working space of a lookup-table file: the space is a known suffix of the name, else sRGB."""
    p = base_name(path)
    ext, name = extension(p), without_extension(p)
    space = F.regexp_extract(name, "(" + "|".join(spaces) + ")$", 1)
    space = F.when(space == "", F.lit("sRGB")).otherwise(space)
    return F.regexp_replace(name, "(" + "|".join(spaces) + ")$", ""), ext, space


def output_name(path: Column, template: str, rank: Column, trashed: Column, sequence: Column, taken: Column) -> Column:
    """An output file name from a template.

    ``%f``: base name without extension; ``%dN``: the N-th directory from the end; ``%r``: rank, x when trashed; ``%sN``:
    the sequence number padded to N digits; ``%t``: the date of capture; ``%%``: a percent sign.  Else text stands for itself.
    """
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out, i = [], 0
    while i < len(template):
        two = template[i : i + 2]
        digit = template[i + 2 : i + 3]
        if two == "%f":
            out.append(without_extension(base_name(path)))
        elif two in ("%d", "%s") and digit.isdigit():
            n = int(digit)
            out.append(F.coalesce(F.get(folders, F.size(folders) - n), F.lit("")) if two == "%d" else F.lpad(sequence.cast("string"), n, "0"))
            i += 1
        elif two == "%r":
            out.append(F.when(trashed, F.lit("x")).otherwise(rank.cast("string")))
        elif two == "%t":
            out.append(F.date_format(taken, "yyyy-MM-dd"))
        elif two == "%%":
            out.append(F.lit("%"))
        else:
            out.append(F.lit(template[i]))
            i -= 1
        i += 2
    return F.concat(*out) if out else F.lit("")
