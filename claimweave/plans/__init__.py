"""Registered queries over the driver's tables, each with its SQL check where SQL can say it."""
