"""Checks of what users ask for: values that can't work, and values beyond the recommended limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import BlindOptions, NearbyOptions
from .solve import LIMITS, SolveOptions

EXTENSIONS = ("fit", "fits", "png", "jpg", "jpeg")


def beyond_limits(options: SolveOptions, plan: BlindOptions | NearbyOptions | None = None) -> list[str]:
    """What of the options is slow or unlikely to solve. Values that can't work raise when the options
    are made."""
    least, most = LIMITS["field_radius"]
    found = []
    if options.max_stars is not None and options.max_stars > LIMITS["max_stars"]:
        found.append(f"max_stars should be at most {LIMITS['max_stars']}")
    for name in ("lower_offset", "higher_offset"):
        if getattr(options, name) > LIMITS["density_offset"]:
            found.append(f"{name} should be at most {LIMITS['density_offset']}")
    if isinstance(plan, NearbyOptions):
        radii = (plan.min_field_radius or plan.max_field_radius, plan.max_field_radius)
        if plan.search_radius > LIMITS["search_radius"]:
            found.append(f"search_radius should be at most {LIMITS['search_radius']:g}")
    else:
        radii = (plan.min_radius, plan.start_radius) if plan else (least, most)
    if radii[1] > most:
        found.append(f"the largest field radius should be at most {most:g}")
    if radii[0] < least:
        found.append(f"the smallest field radius should be at least {least:g}")
    return found


def with_problems(jobs: DataFrame) -> DataFrame:
    """Adds problems, an array of field names and texts, to requested jobs: file_name, n_bytes, mode (nearby
    or blind), use_fits_headers, ra, dec, search_radius, min_radius, max_radius, lower_offset, higher_offset."""
    least, most = LIMITS["field_radius"]
    c = F.col
    nearby, blind = F.coalesce(c("mode") == "nearby", F.lit(False)), F.coalesce(c("mode") == "blind", F.lit(False))
    given = nearby & ~F.coalesce(c("use_fits_headers"), F.lit(False))

    def problem(field: str, when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(text).alias("text")))

    rules = [
        problem("image", c("n_bytes").isNull(), "no image"),
        problem("image", c("n_bytes") == 0, "the image has no bytes"),
        problem("image", ~F.lower(F.regexp_extract(F.coalesce("file_name", F.lit("")), r"\.([^.]*)$", 1)).isin(*EXTENSIONS), f"the extension must be one of {', '.join(EXTENSIONS)}"),
        problem("mode", ~nearby & ~blind, "must be blind or nearby"),
        problem("search_radius", nearby & c("search_radius").isNull(), "must be set for nearby searches"),
        problem("search_radius", nearby & (c("search_radius") > LIMITS["search_radius"]), f"should be at most {LIMITS['search_radius']:g}"),
        problem("use_fits_headers", given & (c("ra").isNull() | c("dec").isNull() | c("min_radius").isNull() | c("max_radius").isNull()), "ra, dec, min_radius and max_radius are needed without headers"),
        problem("max_radius", blind & c("max_radius").isNull(), "must be set for blind searches"),
        problem("max_radius", (given | blind) & (c("max_radius") > most), f"should be at most {most:g}"),
        problem("min_radius", blind & c("min_radius").isNull(), "must be set for blind searches"),
        problem("min_radius", (given | blind) & (c("min_radius") < least), f"should be at least {least:g}"),
        problem("higher_offset", c("higher_offset") > LIMITS["density_offset"], f"should be at most {LIMITS['density_offset']}"),
        problem("lower_offset", c("lower_offset") > LIMITS["density_offset"], f"should be at most {LIMITS['density_offset']}"),
    ]
    return jobs.withColumn("problems", F.filter(F.array(*rules), lambda p: p.isNotNull()))
