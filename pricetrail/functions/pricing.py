"""Money arithmetic in exact decimals, rounded half away from zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricetrail import schemas as S
from pricetrail.functions import text


def discount_percent(price: Column, old_price: Column, scale: int = 1) -> Column:
    """Share of the old price saved; null unless the old price is positive and higher."""
    saved = F.try_divide(old_price - price, old_price) * 100
    return F.when((old_price > 0) & (old_price > price), F.round(saved, scale)).cast(
        f"decimal(18,{scale})"
    )


def grid_discount_percent(price: Column, old_price: Column) -> Column:
    return discount_percent(price, old_price, 0)


def extracted_discount_percent(regular: Column, final: Column) -> Column:
    return discount_percent(final, regular, 0).cast("int")


def price_change_percent(base: Column, target: Column) -> Column:
    change = F.try_divide(target - base, base) * 100
    return F.when(base > 0, F.round(change, 1)).cast(S.PERCENT)


def amount_delta(base: Column, target: Column) -> Column:
    return (target - base).cast(S.MONEY)


def average_price(total: Column, count: Column) -> Column:
    """Exact sum over count; ``avg`` would already have rounded to six places."""
    return F.round(F.try_divide(total, count), 2).cast(S.MONEY)


def snapshot_price(price: Column, old_price: Column) -> Column:
    return F.coalesce(price, old_price)


def run_source_or_default(source: Column, default: str = S.DEFAULT_SOURCE) -> Column:
    return F.coalesce(source, F.lit(default))


def promo_flag(discount: Column, regular: Column, final: Column) -> Column:
    return F.coalesce(discount > 0, F.lit(False)) | F.coalesce(regular > final, F.lit(False))


def strong_discount(promo: Column, discount: Column) -> Column:
    return F.coalesce(promo & (discount > 25), F.lit(False))


def coverage_percent(part: Column, total: Column) -> Column:
    share = F.try_divide(part.cast("decimal(20,0)"), total.cast("decimal(20,0)")) * 100
    return F.when(total > 0, F.round(share, 0).cast("int"))


def coverage_text(part: Column, total: Column) -> Column:
    value = coverage_percent(part, total)
    return F.coalesce(F.concat(value.cast("string"), F.lit("%")), F.lit("Not available"))


def tone(value: Column) -> Column:
    return (
        F.when(value < 0, "success").when(value > 0, "accent")
        .when(value == 0, "neutral").otherwise("muted")
    )


def level_direction(value: Column) -> Column:
    return F.when(value < 0, "below").when(value > 0, "above").when(value == 0, "aligned with")


def move_direction(value: Column) -> Column:
    return F.when(value < 0, "cheaper").when(value > 0, "higher").when(value == 0, "flat")


def _sign(value: Column) -> Column:
    return F.when(value > 0, "+").when(value < 0, "-").otherwise("")


def price_text(value: Column, currency: str = "UAH") -> Column:
    return F.coalesce(
        F.concat(F.format_number(value, 2), F.lit(f" {currency}")), F.lit("Not available")
    )


def signed_price_text(value: Column, currency: str = "UAH") -> Column:
    shown = F.concat(_sign(value), F.format_number(F.abs(value), 2), F.lit(f" {currency}"))
    return F.coalesce(shown, F.lit("No change"))


def signed_percent_text(value: Column) -> Column:
    shown = F.concat(_sign(value), F.format_number(F.abs(value), 1), F.lit("%"))
    return F.coalesce(shown, F.lit("Not available"))


def text_differs(left: Column, right: Column) -> Column:
    def norm(value: Column) -> Column:
        return F.lower(text.strip(F.coalesce(value, F.lit(""))))

    return norm(left) != norm(right)


def value_differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def request_rate(requests: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, requests / seconds).otherwise(F.lit(0.0))


def shown_rate(rate: Column) -> Column:
    return F.round(rate.cast("decimal(28,10)"), 2).cast("double")


def has_valid_state(url: Column, price: Column, old_price: Column, in_stock: Column) -> Column:
    """A url, and a price, an old price or stock."""
    return (url != "") & (
        price.isNotNull() | old_price.isNotNull() | F.coalesce(in_stock, F.lit(False))
    )
