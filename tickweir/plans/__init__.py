"""Studies: staged attribution, model comparison, target study, diagnosis."""
