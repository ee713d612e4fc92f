"""Fixed values of the domain: fact types, enumerations, marks for missing entries."""

# The eleven measurement types, their canonical units and ceilings of the absolute value.
CANONICAL_UNIT = {
    "Overpotential": "mV",
    "TafelSlope": "mV/decade",
    "ExchangeCurrentDensity": "mA/cm2",
    "ChargeTransferCoefficient": "dimensionless",
    "MassActivity": "A/g",
    "TurnoverFrequency": "1/s",
    "ECSA": "cm2",
    "SpecificActivity": "mA/cm2",
    "Stability": "h",
    "PEMWECellVoltage": "V",
    "DegradationRate": "mV/h",
}
MAGNITUDE_CEILING = {
    "Overpotential": 2000.0,
    "TafelSlope": 1000.0,
    "ChargeTransferCoefficient": 2.0,
    "MassActivity": 1e6,
    "TurnoverFrequency": 1e5,
    "SpecificActivity": 1e6,
    "Stability": 1e5,
    "PEMWECellVoltage": 5.0,
}
# Classes that exist in the schema but are never measurements.
OTHER_CLASSES = ["Paper", "Condition", "Electrolyte", "Evidence", "Catalyst", "OxygenEvolutionReaction"]
ENUMS = {
    "iR_correction": ["applied", "not_applied", "unknown"],
    "normalization_basis": ["geometric", "ECSA", "BET", "mass"],
    "cell_type_family": ["RDE", "three_electrode_flow", "single_cell_MEA", "stack"],
    "electrolyte_family": ["acid", "alkaline", "neutral"],
    "scan_rate_regime": ["steady_state", "slow_LSV", "fast_LSV", "fast_CV"],
}
PARSERS = ["mineru", "dots", "paddle", "docling", "chandra"]

# Numbers and marks that stand for a missing entry.
SENTINELS = [-999.0, -9999.0, -99999.0, -999999.0, 999999.0]
MISSING_MARKS = [
    "", "-", "--", "?", ".", "n/a", "na", "n.a.", "n.a", "n/s", "n.s.", "none", "null", "nil", "nan", "unknown",
    "missing", "not stated", "not given", "not available", "tbd", "tba", "other", "unspecified", "—", "–",
]
