"""Names shared by the operators."""

# The key that all facts are aligned to.
KEYS = ("Account_No", "Fiscal_Month", "Product_Category")

# How many times a row stands in the result; see merge.expand_copies.
COPIES = "Copies"

# "corrected" joins the calendar on its day and gives every fact one row per key. "as_written" joins revenue to the
# daily calendar on the name of the month and keeps repeated keys, which repeats a row once per day of its month.
CORRECTED, AS_WRITTEN = "corrected", "as_written"


def check_mode(mode: str) -> bool:
    """True if the mode is ``as_written``."""
    if mode not in (CORRECTED, AS_WRITTEN):
        raise ValueError(f"mode must be {CORRECTED!r} or {AS_WRITTEN!r}, not {mode!r}")
    return mode == AS_WRITTEN
