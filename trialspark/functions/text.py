"""Labels and compact number texts."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DIRECTION_LABELS, LEVEL_LABELS
from .numeric import column, round_even


def recode(col, mapping: dict, default=None) -> Column:
    """Value-by-value replacement; values outside the mapping become `default`."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(pairs, column(col))
    return found if default is None else F.coalesce(found, F.lit(default))


def paste(*cols, sep="") -> Column:
    """Concatenation in which a missing part reads `NA` instead of vanishing."""
    return F.concat_ws(sep, *[F.coalesce(column(c).cast("string"), F.lit("NA")) for c in cols])


def number_text(x, digits=2) -> Column:
    """Rounded number without trailing zeros."""
    text = F.format_string(f"%.{digits}f", column(x))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(column(x).isNotNull(), F.when(short == "-0", F.lit("0")).otherwise(short))


def drop_leading_zero(x) -> Column:
    """`0.5` reads `.5`, first match only; a lone `0` stays."""
    return F.regexp_replace(column(x), r"^([^0]*)0(?=.)", "$1")


def title(x) -> Column:
    return F.initcap(column(x))


def stim_label(direction="bias_direction", level="contrast_level", sep="\n") -> Column:
    """Display form of a stimulus code."""
    return F.concat_ws(sep, recode(direction, DIRECTION_LABELS), recode(level, LEVEL_LABELS))


def fit_name(experiment="experiment", source="bias_source", model="model_name") -> Column:
    """Short name of a fit; the source is cut to three letters."""
    return F.concat_ws("_", column(experiment), F.substring(column(source), 1, 3), column(model))


def bf_text(bf) -> Column:
    """Below 1: two decimals. Above 1: scientific from four digits on, else whole, else two decimals."""
    bf = column(bf)
    whole = round_even(bf)
    return (
        F.when(bf <= 1.0, number_text(bf))
        .when(whole > 999.0, F.format_string("%.1e", bf))
        .when(whole > 1.0, F.format_string("%.0f", whole))
        .otherwise(number_text(bf))
    )


def bf_plot_labels(bf, d) -> list[Column]:
    """Plot-math texts for a Bayes factor and an effect size, alone and stacked."""
    bf_lab = F.concat(F.lit('bold(BF[10]) == "'), bf_text(bf), F.lit('"'))
    d_lab = F.concat(F.lit("italic(d) == "), number_text(d))
    label = F.concat(F.lit("atop("), bf_lab, F.lit(", "), d_lab, F.lit(")"))
    return [bf_lab.alias("bf_lab"), d_lab.alias("d_lab"), label.alias("label")]
