"""Operators: DataFrame -> DataFrame jobs over posting-shaped tables."""
