"""Small sheets as text, cells parted by |, for queries over layouts and their tests."""

from __future__ import annotations

STACKED = """
Income statement
 | 2023 | 2024 | 2025
Revenue | 100 | 110 | 120
Costs | 40 | 45 | 50
EBITDA | 60 | 65 | 70

Balance sheet
 | 2023 | 2024 | 2025
Assets | 500 | 520 | 540
Liabilities | 300 | 310 | 320
Equity | 200 | 210 | 220"""
SIBLINGS = """
 | 2023 | 2024 | 2025 | | CAGR | Avg
Revenue | 100 | 110 | 120 | | 0.1 | 105
Costs | 40 | 45 | 50 | | 0.05 | 45
EBITDA | 60 | 65 | 70 | | 0.08 | 65
NetIncome | 50 | 55 | 60 | | 0.1 | 57"""
YEARS = """
Name | Year | Assets | Deposits
Bank A | 2020 | 100 | 50
Bank A | 2021 | 110 | 55
Bank A | 2022 | 120 | 60
Bank B | 2020 | 200 | 90
Bank B | 2021 | 210 | 95
Bank B | 2022 | 220 | 100"""
CALENDAR = """
Mon | Tue | Wed | Thu | Fri | Sat | Sun
1 | 2 | 3 | 4 | 5 | 6 | 7
8 | 9 | 10 | 11 | 12 | 13 | 14
15 | 16 | 17 | 18 | 19 | 20 | 21
22 | 23 | 24 | 25 | 26 | 27 | 28"""
PRICING = """
Quantity | North | South | East
10 | 5.0 | 5.5 | 6.0
20 | 4.8 | 5.9 | 6.4
30 | 4.1 | 5.2 | 6.9
40 | 3.9 | 4.8 | 7.7"""
BAND = """
 | Group A | Group A | Group B | Group B
 | 2023 | 2024 | 2023 | 2024
Revenue | 10 | 13 | 12 | 18
Costs | 20 | 27 | 22 | 31
EBITDA | 34 | 41 | 39 | 52"""
UNITS = """
Product | Units | Price | Total
Alpha | 1950 | 5 | 9750
Beta | 2010 | 7 | 14070
Gamma | 1980 | 6 | 11880"""
FORECAST = """
Name | Year | Metric0 | Metric1 | Metric2 | Metric3 | Metric4
Foo | 2020 | 200 | 10 | 20 | 30 | 40
Foo | 2021 | 210 | 41 | 42 | 43 | 44
Foo | 2022 | 463 | 590.4 | 670.9 | 752.2 | 834.9
Foo | 2023 | 463 | 111 | 112 | 113 | 114
Foo | 2024 | 1620 | 121 | 122 | 123 | 124
Foo | 2025 | 2786 | 131 | 132 | 133 | 134"""
CAPTION = """
 | Growth (%)
Name | Q1 | Q2 | Q3
Foo | 10 | 11 | 12
Bar | 20 | 21 | 22
Baz | 30 | 31 | 32"""
SECTIONS = """
 | 2023 | 2024
Funding
Deposits | 100 | 110
Savings | 200 | 210
Total Funding | 300 | 320
Loans
Mortgages | 150 | 160
Auto | 90 | 95
Total Loans | 240 | 255"""
ANCHOR = """
 | 2023 | 2024 | | CAGR | Avg
Revenue | 100 | 110 | | 0.1 | 105
Costs | 40 | 44 | | 0.1 | 42
EBITDA | 60 | 66 | | 0.1 | 63
Other income | | | | 5 | 6
Other costs | | | | 7 | 8"""
BETWEEN = """
 | 2023 | 2024 | | | Current | Prior
Revenue | 100 | 110 | | | 10 | 11
Costs | 40 | 44 | Short A | Short B | 20 | 22
EBITDA | 60 | 66 | 1 | 2 | 30 | 33
Tax | 25 | 28 | 3 | 4 | 40 | 44
Cash | 35 | 38 | | | 50 | 55"""
MATRIX = """
Sensitivity
 | 0.5 | 1.0 | 1.5 | 2.0 | 2.5
3.2 | 11 | 12 | 14 | 17 | 21
4.2 | 12 | 15 | 13 | 19 | 22
5.2 | 10 | 12 | 11 | 13 | 12
6.2 | 9 | 8 | 10 | 11 | 7
7.2 | 3 | 4 | 6 | 5 | 8"""

SHEETS = {"Stacked": STACKED, "Siblings": SIBLINGS, "Years": YEARS, "Calendar": CALENDAR, "Pricing": PRICING, "Band": BAND, "Units": UNITS, "Forecast": FORECAST, "Caption": CAPTION, "Sections": SECTIONS, "Anchor": ANCHOR, "Between": BETWEEN, "Matrix": MATRIX}


def rows_of(text: str) -> list[list]:
    """Rows of numbers, text and empty cells."""

    def value(raw: str):
        try:
            return float(raw)
        except ValueError:
            return raw or None

    return [[value(x.strip()) for x in line.split("|")] for line in text.strip("\n").split("\n")]
