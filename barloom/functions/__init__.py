"""Feature definitions; importing the package fills the registry."""

from barloom.functions import moving, trend, oscillators, volatility, volume, candles, helpers, swings, machines, price_action, charts, states, labels, contexts, trend_class, pullback_quality, alignment, confluence  # noqa: F401, I001
