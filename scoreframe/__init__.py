"""scoreframe: scores of model outputs as Spark columns, computed set-at-a-time."""
