"""Structure-activity analytics as DataFrame plans on Spark."""
