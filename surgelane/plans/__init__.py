"""End-to-end plans: ETL, features, model, flagship report, job entry."""
