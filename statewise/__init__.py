"""statewise: perturbation-response analytics as Spark DataFrame plans."""
