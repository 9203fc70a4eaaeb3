"""Golden values of the reference's air-traffic data (yearly totals in thousands of passengers,
summed from its two monthly files), typed in so tests never read the reference.

Fixed values: year -> (domestic, international, total); 2021 has five months (January..May).
"""

YEARLY = {
    2000: (599851, 74399, 674250), 2001: (560337, 68930, 629267), 2002: (554020, 67586, 621606),
    2003: (587729, 68999, 656728), 2004: (634638, 79377, 714015), 2005: (660914, 86260, 747174),
    2006: (660928, 89862, 750790), 2007: (681877, 94112, 775989), 2008: (654340, 94898, 749238),
    2009: (620812, 88475, 709287), 2010: (632640, 93906, 726546), 2011: (641575, 95817, 737392),
    2012: (645141, 97677, 742818), 2013: (648249, 100288, 748537), 2014: (665488, 102632, 768120),
    2015: (698454, 105125, 803579), 2016: (722253, 106509, 828762), 2017: (744214, 109671, 853885),
    2018: (780313, 113181, 893494), 2019: (814144, 116808, 930952), 2020: (336649, 35523, 372172),
    2021: (185248, 17888, 203136),
}

# Imputation of the seven missing months of 2021 ("spread": divide by the missing-month count).
SPREAD_2021 = {"pax": 29019, "internationalPax": 2555, "domesticPax": 26464}
MEAN_2021 = {"pax": 40627, "internationalPax": 3577, "domesticPax": 37049}

# MLlib LinearRegression (elasticNet 0.8) on the yearly totals: (regParam, last training year,
# slope, intercept).
FITS = [
    (0.5, 2019, 12077.8378008, -23517293.6107),
    (0.3, 2019, 12077.8717032, -23517361.7375),
]
