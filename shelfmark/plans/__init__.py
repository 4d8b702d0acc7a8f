"""Star schema, marts, reports and checks, composed of the operators."""
