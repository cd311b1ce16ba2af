"""End-to-end plans: training, forecasting, jobs and the registered query catalog."""
