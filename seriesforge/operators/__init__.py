"""DataFrame → DataFrame operators: series, metadata, imputation, forecasting."""
