"""From headers to plans: the header model and the columns generated from it."""
