"""Operators for preparing large training collections. Nothing outside this folder imports it."""
