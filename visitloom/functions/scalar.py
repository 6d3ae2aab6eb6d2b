"""Column expressions. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitloom.config import SCORE_THRESHOLDS, SEVERITY_CODES, SEVERITY_CUTS


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def rounded(c, places: int = 6) -> Column:
    return F.round(_col(c).cast("double"), places)


def cents(amount) -> Column:
    """Amount in whole hundredths. Integer sums do not depend on row order and,
    unlike wide decimals, stay in fixed-width aggregation buffers."""
    return F.floor(_col(amount) * 100 + F.lit(0.5)).cast("bigint")


def from_cents(total) -> Column:
    return _col(total) / F.lit(100.0)


def feature_key(peptide, protein, peptide_first: bool = True) -> Column:
    """Composite name; NULL when either part is NULL."""
    parts = (_col(peptide), _col(protein)) if peptide_first else (_col(protein), _col(peptide))
    return F.concat(parts[0], F.lit("_"), parts[1])


def visit_key(patient, month, given=None) -> Column:
    """``patient_month``, used only where no visit id was given."""
    made = F.concat(_col(patient).cast("string"), F.lit("_"), _col(month).cast("string"))
    return made if given is None else F.coalesce(_col(given), made)


def severity(score, target: str) -> Column:
    """mild / moderate / severe. A NULL score falls to the last branch."""
    mild, moderate = SEVERITY_CUTS[target]
    x = _col(score)
    return (
        F.when(x <= mild, "mild").when(x <= moderate, "moderate").otherwise("severe")
    )


def binary_severity(score, target: str) -> Column:
    """0 for mild, else 1; a NULL score gives 1."""
    return F.when(_col(score) <= SEVERITY_CUTS[target][0], 0).otherwise(1)


def by_target(target, per_target) -> Column:
    """One expression per target value, chosen by the ``target`` column."""
    items = list(per_target.items())
    out = F.when(_col(target) == items[0][0], items[0][1])
    for name, expr in items[1:]:
        out = out.when(_col(target) == name, expr)
    return out


def severity_of(score, target="target") -> Column:
    return by_target(target, {t: severity(score, t) for t in SEVERITY_CUTS})


def binary_severity_of(score, target="target") -> Column:
    return by_target(target, {t: binary_severity(score, t) for t in SEVERITY_CUTS})


def _literal_map(codes: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])


def map_codes(c, codes: dict = SEVERITY_CODES) -> Column:
    """Dictionary map: a key that is not in ``codes`` gives NULL."""
    return F.try_element_at(_literal_map(codes), _col(c))


def replace_codes(c, codes: dict) -> Column:
    """Dictionary replace: a key that is not in ``codes`` is kept."""
    return F.coalesce(F.try_element_at(_literal_map(codes), _col(c)), _col(c))


def medication_dummies(med) -> dict[str, Column]:
    """Indicator columns; NULL counts as Unknown, and "Off" is the dropped level."""
    m = F.coalesce(_col(med), F.lit("Unknown"))
    return {
        "med_on": (m == "On").cast("int"),
        "med_unknown": (m == "Unknown").cast("int"),
    }


def protein_of(feature, legacy: bool = False) -> Column:
    """Protein id in a feature name: the last ``_`` part.

    ``legacy`` takes the second part instead, which breaks on peptide names
    that hold an underscore themselves. A name without ``_`` is its own id.
    """
    parts = F.split(_col(feature), "_")
    if not legacy:
        return F.element_at(parts, -1)
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2))).otherwise(_col(feature))


def severity_label(target, prediction) -> Column:
    """Display text of a 0/1 prediction."""
    return by_target(
        target,
        {
            t: F.when(_col(prediction) == 1, f"> {cut} (Moderate-to-Severe)").otherwise(
                f"< {cut + 1} (None-to-Mild)"
            )
            for t, (cut, _) in SEVERITY_CUTS.items()
        },
    )


def sign_flag(x) -> Column:
    """0 for zero, 1 above zero, NULL otherwise."""
    return F.when(_col(x) == 0, 0).when(_col(x) > 0, 1)


def call_at_threshold(target, probability, thresholds: dict = SCORE_THRESHOLDS) -> Column:
    limit = by_target(target, {t: F.lit(v) for t, v in thresholds.items()})
    return (_col(probability) >= limit).cast("int")


def shuffle_key(seed: int, key) -> Column:
    """Order key of the seeded shuffle; equal on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def shuffle_bucket(order_key, n_rows=None) -> Column:
    """Leading hex digits of a shuffle key: monotone in it, and even.

    With ``n_rows`` the digits follow the number of rows, so that a bucket holds
    some 100,000 rows at most up to a hundred billion rows.
    """
    digits = F.lit(3)
    if n_rows is not None:
        n = _col(n_rows)
        digits = F.when(n < 10_000_000, 2).when(n < 1_000_000_000, 4).otherwise(5)
    return F.conv(F.substr(_col(order_key), F.lit(1), digits), 16, 10).cast("bigint")


def hash_score(key) -> Column:
    """Deterministic pseudo-probability in [0, 1] of a key."""
    bits = F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 7), 16, 10).cast("bigint")
    return bits / F.lit(268435455.0)


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson r from moments; NULL when either side is constant."""
    n, sx, sy, sxx, syy, sxy = map(_col, (n, sx, sy, sxx, syy, sxy))
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    # a constant column leaves rounding dust, not an exact zero
    flat = (vx <= F.lit(1e-9) * n * sxx) | (vy <= F.lit(1e-9) * n * syy)
    return F.when(~flat, (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def yeo_johnson(x, lam) -> Column:
    """Yeo-Johnson transform of ``x`` at ``lam``."""
    x, lam = _col(x), _col(lam)
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise(
        F.try_divide(F.pow(x + 1, lam) - 1, lam)
    )
    down = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(
        -F.try_divide(F.pow(1 - x, 2 - lam) - 1, 2 - lam)
    )
    return F.when(x >= 0, up).otherwise(down)


def smape_term(truth, prediction) -> Column:
    """|p-t| over the mean magnitude; NULL for 0/0, so averages skip it."""
    t, p = _col(truth), _col(prediction)
    return F.try_divide(F.abs(p - t).cast("double"), (F.abs(t) + F.abs(p)) / F.lit(2.0))
