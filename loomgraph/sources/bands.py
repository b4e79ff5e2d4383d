"""Size bands of the firm-count table."""

from __future__ import annotations

#: Name, lower and upper bound of each band, as the count table has them.
BANDS = (
    ("$0-99,000", 0, 99_000),
    ("$100,000-499,000", 100_000, 499_000),
    ("$500,000-999,000", 500_000, 999_000),
    ("$1,000,000-2,499,000", 1_000_000, 2_499_000),
    ("$2,500,000-4,999,000", 2_500_000, 4_999_000),
    ("$5,000,000-7,499,000", 5_000_000, 7_499_000),
    ("$7,500,000-9,999,000", 7_500_000, 9_999_000),
    ("$10,000,000-14,999,000", 10_000_000, 14_999_000),
    ("$15,000,000-19,999,000", 15_000_000, 19_999_000),
    ("$20,000,000-24,999,000", 20_000_000, 24_999_000),
    ("$25,000,000-29,999,000", 25_000_000, 29_999_000),
    ("$30,000,000-34,999,000", 30_000_000, 34_999_000),
    ("$35,000,000-39,999,000", 35_000_000, 39_999_000),
    ("$40,000,000-44,999,000", 40_000_000, 44_999_000),
    ("$45,000,000-49,999,000", 45_000_000, 49_999_000),
    ("50,000,000-74,999,000", 50_000_000, 74_990_000),
    ("$75,000,000-99,999,000", 75_000_000, 99_990_000),
    ("$100,000,000+", 100_000_000, 10_000_000_000),
)
