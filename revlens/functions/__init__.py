from revlens.functions.semantics import (  # noqa: F401
    MILLION, THOUSAND, day_diff, dec_lit, exact_mean, first_match, half_even,
    month_boundaries, month_name, month_name_of, num_text, pct_change, pct_label, range_bucket,
    safe_div, scale_round, scale_round_dec, share_pct, snap_round)
