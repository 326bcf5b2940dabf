"""Fixed values of the model: factor space, dynamics, stream loadings and noise, regimes and transition matrices."""

# Fixed values, all of them, to be used as they are.
FACTORS = ("inflation_trend", "growth_trend", "labor_pressure", "housing_momentum", "financial_conditions", "commodity_pressure", "consumer_sentiment", "policy_stance")
PERSISTENCE = {
    "inflation_trend": 0.97,
    "growth_trend": 0.96,
    "labor_pressure": 0.96,
    "housing_momentum": 0.98,
    "financial_conditions": 0.95,
    "commodity_pressure": 0.85,
    "consumer_sentiment": 0.96,
    "policy_stance": 0.98,
}
CROSS_DYNAMICS = (  # from, to, coefficient
    ("policy_stance", "financial_conditions", 0.07),
    ("financial_conditions", "housing_momentum", 0.04),
    ("commodity_pressure", "inflation_trend", 0.06),
    ("labor_pressure", "consumer_sentiment", 0.03),
    ("growth_trend", "labor_pressure", 0.04),
    ("growth_trend", "inflation_trend", 0.05),
    ("labor_pressure", "housing_momentum", -0.05),
    ("housing_momentum", "financial_conditions", 0.04),
)
Q_SCALE = 0.01
INITIAL_VARIANCE = 0.1
STREAM_LOADINGS = {
    "US_CPI_YOY": {"inflation_trend": 0.85, "growth_trend": 0.10, "labor_pressure": 0.05, "housing_momentum": 0.15, "commodity_pressure": 0.20, "policy_stance": 0.10},
    "CORE_CPI": {"inflation_trend": 0.90, "growth_trend": 0.05, "labor_pressure": 0.10, "housing_momentum": 0.20, "policy_stance": 0.10},
    "PPI": {"inflation_trend": 0.60, "growth_trend": 0.15, "commodity_pressure": 0.50},
    "NONFARM_PAYROLLS": {"growth_trend": 0.30, "labor_pressure": 0.85, "financial_conditions": 0.10, "consumer_sentiment": 0.15},
    "UNEMPLOYMENT_RATE": {"growth_trend": -0.25, "labor_pressure": -0.80, "financial_conditions": -0.10, "consumer_sentiment": -0.20},
    "INITIAL_CLAIMS": {"growth_trend": -0.20, "labor_pressure": -0.70, "consumer_sentiment": -0.15},
    "HOUSING_STARTS": {"growth_trend": 0.20, "housing_momentum": 0.85, "financial_conditions": 0.30, "consumer_sentiment": 0.20, "policy_stance": -0.25},
    "HOME_PRICES": {"inflation_trend": 0.20, "growth_trend": 0.15, "housing_momentum": 0.75, "financial_conditions": 0.20, "consumer_sentiment": 0.15, "policy_stance": -0.15},
    "RETAIL_SALES": {"growth_trend": 0.50, "labor_pressure": 0.15, "financial_conditions": 0.10, "consumer_sentiment": 0.60},
    "CONSUMER_CONFIDENCE": {"growth_trend": 0.25, "labor_pressure": 0.10, "consumer_sentiment": 0.85},
    "OIL_PRICE": {"inflation_trend": 0.25, "growth_trend": 0.15, "financial_conditions": 0.10, "commodity_pressure": 0.90},
    "GOLD_PRICE": {"inflation_trend": 0.10, "growth_trend": -0.10, "financial_conditions": -0.40, "commodity_pressure": 0.30, "policy_stance": -0.20},
    "COPPER_PRICE": {"growth_trend": 0.40, "housing_momentum": 0.20, "commodity_pressure": 0.60},
    "FED_FUNDS_RATE": {"inflation_trend": 0.15, "financial_conditions": 0.20, "policy_stance": 0.90},
    "10Y_YIELD": {"inflation_trend": 0.30, "growth_trend": 0.25, "financial_conditions": 0.50, "policy_stance": 0.40},
    "SP500": {"growth_trend": 0.35, "financial_conditions": 0.50, "consumer_sentiment": 0.30, "policy_stance": -0.20},
    "BTC_USD": {"growth_trend": 0.15, "financial_conditions": 0.40, "consumer_sentiment": 0.25, "policy_stance": -0.15},
    "COMMODITY_PRESSURE_RAW": {"commodity_pressure": 0.80, "inflation_trend": 0.15, "growth_trend": 0.10},
}
STREAM_NOISE = {
    "US_CPI_YOY": 0.03, "CORE_CPI": 0.03, "PPI": 0.08, "NONFARM_PAYROLLS": 0.10, "UNEMPLOYMENT_RATE": 0.08, "INITIAL_CLAIMS": 0.05,
    "HOUSING_STARTS": 0.12, "HOME_PRICES": 0.05, "RETAIL_SALES": 0.08, "CONSUMER_CONFIDENCE": 0.10, "OIL_PRICE": 0.05, "GOLD_PRICE": 0.05,
    "COPPER_PRICE": 0.06, "FED_FUNDS_RATE": 0.01, "10Y_YIELD": 0.03, "SP500": 0.05, "BTC_USD": 0.08, "COMMODITY_PRESSURE_RAW": 0.06,
}
FREQUENCY_SCALE = {
    "BTC_USD": 16.0, "SP500": 16.0, "OIL_PRICE": 16.0, "COPPER_PRICE": 16.0, "COMMODITY_PRESSURE_RAW": 16.0, "INITIAL_CLAIMS": 7.0,
    "HOUSING_STARTS": 7.0, "US_CPI_YOY": 3.5, "CORE_CPI": 3.5, "PPI": 3.5, "NONFARM_PAYROLLS": 3.5, "UNEMPLOYMENT_RATE": 3.5,
    "RETAIL_SALES": 3.5, "HOME_PRICES": 3.5, "CONSUMER_CONFIDENCE": 2.0, "FED_FUNDS_RATE": 1.0, "10Y_YIELD": 1.0, "GOLD_PRICE": 1.0,
}
ANOMALY_THRESHOLD = 3.5
REGIMES = ("soft_landing", "stagflation", "recession")
REGIME_ADJUSTMENTS = {
    "soft_landing": {"inflation_trend": -0.200, "growth_trend": 0.200, "labor_pressure": -0.150, "consumer_sentiment": 0.150, "policy_stance": -0.100},
    "stagflation": {"inflation_trend": 1.063, "growth_trend": 0.195, "labor_pressure": 0.320, "housing_momentum": 0.360, "financial_conditions": 0.247, "consumer_sentiment": 0.100, "policy_stance": 0.171},
    "recession": {"inflation_trend": -0.712, "growth_trend": -0.215, "labor_pressure": -0.421, "housing_momentum": -0.329, "financial_conditions": -0.365, "consumer_sentiment": -0.154, "policy_stance": -0.453, "commodity_pressure": -0.060},
}
TRANSITIONS = ((0.970, 0.020, 0.010), (0.030, 0.950, 0.020), (0.050, 0.020, 0.930))
TEMPER_FLOOR, TEMPER_CEILING, TEMPER_HORIZON = 0.3, 0.7, 200
PROBABILITY_FLOOR, PROBABILITY_CEILING = 0.005, 0.99
LIKELIHOOD_FLOOR = 1e-10
REGIME_PULL, NEUTRAL_SHRINK = 0.10, 0.90
GAS_BETA, GAS_ALPHA, GAS_MAX_RATIO, GAS_LOW, GAS_HIGH = 0.95, 0.10, 50.0, -6.0, 4.0
GAP_SLOPE = 0.05
#: Noise multipliers of each regime by class of streams, and its process-noise scale.
STREAM_CLASSES = {
    "financial": ("SP500", "BTC_USD", "INITIAL_CLAIMS", "GOLD_PRICE"),
    "commodity": ("OIL_PRICE", "COPPER_PRICE", "PPI", "COMMODITY_PRESSURE_RAW"),
    "housing": ("HOUSING_STARTS", "HOME_PRICES"),
}
REGIME_NOISE = {
    "soft_landing": {"financial": 1.0, "commodity": 1.0, "housing": 1.0, "other": 1.0},
    "stagflation": {"financial": 2.0, "commodity": 2.5, "housing": 1.5, "other": 1.2},
    "recession": {"financial": 3.0, "commodity": 2.0, "housing": 2.5, "other": 1.5},
}
REGIME_Q = {"soft_landing": 1.0, "stagflation": 1.5, "recession": 2.0}
#: Shocks that two factors share, as a part of the geometric mean of their variances.
SHARED_SHOCKS = (
    ("commodity_pressure", "inflation_trend", 0.30),
    ("financial_conditions", "housing_momentum", 0.25),
    ("policy_stance", "financial_conditions", 0.25),
    ("growth_trend", "labor_pressure", 0.20),
)
DATA_PERSISTENCE = {
    "inflation_trend": 0.9994,
    "growth_trend": 0.9617,
    "labor_pressure": 0.9881,
    "housing_momentum": 0.9989,
    "financial_conditions": 0.9698,
    "commodity_pressure": 0.50,
    "consumer_sentiment": 0.9979,
    "policy_stance": 0.9996,
}
DATA_WEIGHT, MOST_PERSISTENT = 0.70, 0.999
#: Streams that are seen less than daily.
SLOW_STREAMS = ("US_CPI_YOY", "CORE_CPI", "PPI", "NONFARM_PAYROLLS", "UNEMPLOYMENT_RATE", "RETAIL_SALES", "HOME_PRICES", "CONSUMER_CONFIDENCE", "FED_FUNDS_RATE", "INITIAL_CLAIMS", "HOUSING_STARTS")
#: From regime, to regime, weights of the factors, least and most probability.
EXIT_RULES = (
    (0, 2, {"financial_conditions": -0.8, "growth_trend": -0.6, "consumer_sentiment": -0.4}, 0.005, 0.050),
    (0, 1, {"inflation_trend": 0.8, "commodity_pressure": 0.6, "growth_trend": -0.3}, 0.005, 0.060),
    (2, 0, {"financial_conditions": 0.7, "growth_trend": 0.6, "consumer_sentiment": 0.4}, 0.020, 0.120),
    (1, 0, {"inflation_trend": -0.8, "commodity_pressure": -0.5, "growth_trend": 0.4}, 0.010, 0.080),
    (1, 2, {"growth_trend": -0.7, "financial_conditions": -0.6, "labor_pressure": -0.4}, 0.005, 0.060),
    (2, 1, {"inflation_trend": 0.7, "commodity_pressure": 0.6}, 0.005, 0.050),
)
LEAST_STAY = 0.50
#: Sub-regimes: shifts on top of their regime's, and their transitions.
SUB_REGIMES = {
    "soft_landing": {
        "goldilocks": {"growth_trend": 0.050, "inflation_trend": -0.050, "consumer_sentiment": 0.100, "financial_conditions": 0.050},
        "boom": {"growth_trend": 0.300, "inflation_trend": 0.350, "labor_pressure": 0.250, "housing_momentum": 0.300, "financial_conditions": 0.150, "consumer_sentiment": 0.100},
        "disinflation": {"inflation_trend": -0.350, "policy_stance": 0.300, "growth_trend": -0.100, "labor_pressure": -0.100},
    },
    "stagflation": {
        "cost_push": {"commodity_pressure": 0.350, "growth_trend": -0.300, "financial_conditions": -0.200, "consumer_sentiment": -0.150, "labor_pressure": -0.100},
        "demand_pull": {"growth_trend": 0.300, "consumer_sentiment": 0.200, "labor_pressure": 0.150, "commodity_pressure": -0.050, "financial_conditions": 0.100},
    },
    "recession": {
        "credit_crunch": {"financial_conditions": -0.400, "housing_momentum": -0.300, "growth_trend": 0.100, "policy_stance": -0.200, "inflation_trend": 0.050},
        "demand_shock": {"growth_trend": -0.350, "labor_pressure": -0.300, "consumer_sentiment": -0.200, "inflation_trend": -0.250, "financial_conditions": 0.050},
    },
}
SUB_TRANSITIONS = {
    "soft_landing": ((0.950, 0.030, 0.020), (0.050, 0.920, 0.030), (0.060, 0.010, 0.930)),
    "stagflation": ((0.940, 0.060), (0.080, 0.920)),
    "recession": ((0.960, 0.040), (0.100, 0.900)),
}
SUB_FLOOR = 0.05
ACTIVE_AT = 0.20
#: Exits that a regime's age raises: regime, targets, weeks of half the rise, least and most total chance, slope.
DURATION_EXITS = ((2, (0,), 39, 0.050, 0.150, 0.08), (0, (1, 2), 180, 0.030, 0.060, 0.03))
#: Loadings by regime: factors of the loadings on each factor (an option that the shipped stack leaves off).
REGIME_LOADINGS = {
    "soft_landing": {},
    "stagflation": {"inflation_trend": 1.3, "commodity_pressure": 1.4, "growth_trend": 0.7, "consumer_sentiment": 0.8, "policy_stance": 1.2},
    "recession": {"labor_pressure": 1.4, "financial_conditions": 1.3, "housing_momentum": 1.3, "growth_trend": 1.2, "inflation_trend": 0.7, "commodity_pressure": 0.8, "consumer_sentiment": 1.2},
}
#: Triggers: hours of cooldown, default action, place in the order of urgency.
TRIGGERS = {
    "tier_crossing": (1.0, "llm_reevaluate", 6),
    "anomalous_data": (0.5, "alert_user", 3),
    "sustained_drift": (6.0, "llm_reevaluate", 7),
    "convergence": (12.0, "suggest_merge", 9),
    "narrative_stale": (24.0, "refresh_narrative", 10),
    "branch_extinction": (12.0, "suggest_prune", 8),
    "structural_break": (1.0, "llm_reevaluate", 1),
    "innovation_streak": (6.0, "alert_user", 5),
    "multi_factor_surprise": (8.0, "llm_reevaluate", 4),
    "boundary_approach": (4.0, "alert_user", 2),
}
#: Qualitative signals: noise and value by size of the impact, half-life in days by kind.
SIGNAL_SIZES = {"minor": (5.0, 0.15), "moderate": (1.0, 0.40), "major": (0.3, 0.80)}
SIGNAL_HALF_LIVES = {"breaking": 3, "sentiment": 5, "commentary": 14, "action": 60, "structural": 30, "pattern": 45, "geopolitical": 21, "scenario": 14}
#: Sticky transitions of sub-regimes when evidence is smoothed over time.
STICKY_TRANSITIONS = {
    "soft_landing": ((0.85, 0.10, 0.05), (0.12, 0.78, 0.10), (0.15, 0.05, 0.80)),
    "stagflation": ((0.88, 0.12), (0.12, 0.88)),
    "recession": ((0.85, 0.15), (0.15, 0.85)),
}
#: Evidence for sub-regimes: weight and quantity; a quantity counts where it is above zero. Slopes and their change are a hundredfold.
EVIDENCE = {
    "goldilocks": (
        (1.5, "least(growth + 0.5, 1.0)"), (-0.5, "growth - 1.0"), (1.5, "1.0 - abs(inflation)"), (1.0, "0.5 - abs(policy)"),
        (1.0, "1.0 - abs(inflation_slope)"), (0.5, "1.0 - abs(growth_slope)"), (0.5, "1.5 - stress"), (0.5, "sentiment"),
        (-1.0, "labor - 0.5"), (-0.5, "housing - 0.8"), (-1.0, "inflation - 0.8"), (-1.5, "1.0"),
    ),
    "boom": (
        (1.5, "growth - 0.3"), (1.0, "growth_slope"), (1.0, "labor"), (1.0, "inflation + inflation_slope"), (1.0, "housing"), (1.0, "hot - 1"),
        (1.0, "least(1.5, 1.5 * stocks_20)"), (0.5, "finance"), (0.5, "sentiment"), (-1.0, "-inflation_slope - 0.5"), (-1.0, "-finance - 0.3"), (-0.5, "-sentiment - 0.3"),
    ),
    "disinflation": (
        (1.5, "-inflation_slope - 0.15"), (0.5, "-inflation_change - 0.1"), (1.0, "inflation + 0.1"), (1.5, "policy"), (1.0, "rate_change_10"), (0.5, "growth"),
        (0.5, "-inflation_surprise"), (-2.0, "inflation_slope"), (-1.0, "-growth - 0.3"), (-1.0, "-policy"),
        (-1.5, "greatest(labor - 0.3, 0) + greatest(housing - 0.3, 0) + greatest(growth - 0.3, 0) - 0.3"),
    ),
    "cost_push": (
        (1.5, "commodity"), (1.5, "least(2.5, 1.5 * oil_20)"), (1.5, "price_spread"), (1.0, "inflation"), (1.0, "-growth"), (0.5, "-growth_slope"), (0.5, "-sentiment"),
        (-1.5, "growth - 0.3"), (-1.0, "sentiment - 0.3"), (-0.5, "labor - 0.3"),
    ),
    "demand_pull": (
        (1.5, "growth"), (1.0, "labor"), (1.0, "sentiment"), (1.0, "inflation"), (0.5, "least(1.5, stocks_20)"), (0.5, "-price_spread"),
        (-1.0, "least(2.0, oil_20)"), (-1.0, "commodity - 0.5"), (-0.5, "-growth"),
    ),
    "credit_crunch": (
        (1.5, "-finance"), (1.0, "-finance_slope"), (1.0, "least(2.5, -stocks_60) * (case when finance_lead > 0 then 1.0 else 0.3 end)"), (1.5, "finance_lead"),
        (0.5, "-yield_curve"), (1.0, "-housing"), (2.0, "-housing_slope"), (-0.5, "-finance_lead - 0.3"),
    ),
    "demand_shock": (
        (2.0, "greatest(-growth, 0) + greatest(-sentiment, 0) + greatest(-labor, 0) + greatest(-housing, 0)"), (1.5, "-growth_slope_5"), (1.0, "-sentiment_slope_5"), (0.5, "-labor_slope_5"),
        (0.5, "stress - 1.0"), (0.5, "least(1.5, 2 * unemployment_change)"), (0.5, "least(1.5, 2 * claims_change)"), (1.5, "-finance_lead"), (-0.5, "finance_lead - 0.3"),
    ),
}
SOFTMAX_TEMPERATURE, DELTA_AMPLIFICATION, ENSEMBLE_SHARE = 0.5, 3.0, 0.6
#: Streams whose surprises count towards inflation and growth.
INFLATION_STREAMS, GROWTH_STREAMS = ("US_CPI_YOY", "CORE_CPI", "PPI"), ("RETAIL_SALES", "HOUSING_STARTS", "SP500")
