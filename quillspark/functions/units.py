"""Units of measure: a lookup of aliases."""

from __future__ import annotations

#: Alias, canonical unit, dimension, scale to the canonical unit. Case counts.
UNITS = [
    ("kg", "kg", "mass", 1.0), ("g", "kg", "mass", 1e-3), ("mg", "kg", "mass", 1e-6), ("t", "kg", "mass", 1e3),
    ("m", "m", "length", 1.0), ("km", "m", "length", 1e3), ("cm", "m", "length", 1e-2), ("mm", "m", "length", 1e-3),
    ("s", "s", "time", 1.0), ("min", "s", "time", 60.0), ("h", "s", "time", 3600.0), ("ms", "s", "time", 1e-3),
    ("W", "W", "power", 1.0), ("kW", "W", "power", 1e3), ("MW", "W", "power", 1e6),
    ("J", "J", "energy", 1.0), ("kJ", "J", "energy", 1e3), ("V", "V", "voltage", 1.0), ("A", "A", "current", 1.0),
    ("%", "%", "ratio", 1.0), ("°C", "°C", "temperature", 1.0),
]
#: Words that end a subject, and the dimension that it then must have; the first that fits counts.
QUANTITIES = [("mass", "mass"), ("weight", "mass"), ("length", "length"), ("height", "length"), ("span", "length"), ("distance", "length"), ("duration", "time"), ("time", "time"), ("power", "power"), ("energy", "energy"), ("voltage", "voltage"), ("current", "current"), ("temperature", "temperature")]
