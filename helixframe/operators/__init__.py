"""Operators over ``variants`` frames and header-line frames."""
