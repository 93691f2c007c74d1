"""Candela: candle analytics and event studies as PySpark DataFrame operators."""
