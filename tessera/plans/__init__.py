"""Physical-strategy decisions made from cheap Spark statistics: size-checked
broadcast, hot-key splitting and the product strategy chooser."""
