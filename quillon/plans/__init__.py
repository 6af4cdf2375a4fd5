"""Models, requests and the planner."""
