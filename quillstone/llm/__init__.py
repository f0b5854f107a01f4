"""Operators of a large-scale training-data pipeline. Nothing else imports them."""
