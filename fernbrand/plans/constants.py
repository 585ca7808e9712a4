"""The constants of the SQL, written out for it alone, so that a wrong one in the formulas shows."""

# A, b, c of each fuel's spread curve, then where the buildup effect begins and its q, p, k1, k2.
CURVES = {
    "C-1": (90, 0.0649, 4.5, 60, 0.92, 0.91, 50, 450),
    "C-2": (110, 0.0282, 1.5, 35, 0.8, 0.92, 45, 300),
    "C-3": (110, 0.0444, 3.0, 40, 0.8, 0.9, 45, 350),
    "C-4": (110, 0.0293, 1.5, 35, 0.8, 0.9, 45, 320),
    "C-5": (30, 0.0697, 4.0, 40, 0.8, 0.9, 45, 350),
    "C-6": (30, 0.08, 3.0, 35, 0.8, 0.9, 45, 300),
    "C-7": (45, 0.0305, 2.0, 40, 0.8, 0.9, 45, 350),
    "D-1": (30, 0.0232, 1.6, 40, 0.8, 0.9, 45, 350),
    "O-1A": (190, 0.031, 1.4, None, None, None, None, None),
    "O-1B": (250, 0.035, 1.7, None, None, None, None, None),
    "S-1": (75, 0.0297, 1.3, 35, 0.8, 0.9, 45, 300),
    "S-2": (40, 0.0438, 1.7, 35, 0.8, 0.9, 45, 300),
    "S-3": (55, 0.0829, 3.2, 35, 0.8, 0.9, 45, 300),
}
FUELS = (*CURVES, "M-1", "M-2", "M-3", "M-4")
# Fuel of each numeric code.
FUEL_CODES = {
    1: "C-1", 2: "C-2", 3: "C-3", 4: "C-4", 5: "C-5", 6: "C-6", 7: "C-7", 11: "D-1", 12: "D-1", 13: "D-1", 21: "S-1", 22: "S-2", 23: "S-3", 31: "O-1A", 32: "O-1B", 40: "M-1", 50: "M-2",
    60: "M-3", 70: "M-4",
}
# Day-length factors from January on.
DMC_DAY = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_DAY = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
# What is possible, and values whose runs are ordinary.
LIMITS = {"temperature": (-80, 60), "relative_humidity": (0, 100), "wind_speed": (0, 400), "precipitation": (0, 400)}
ORDINARY_RUNS = {"wind_speed": 0, "precipitation": 0, "relative_humidity": 100}
