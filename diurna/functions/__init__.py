"""Part of diurna."""
