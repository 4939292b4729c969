"""Tables in, models in and out."""
