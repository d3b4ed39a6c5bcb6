"""Early stopping on the published validation history."""

from narrata.operators.history import best_epochs, history_rows, training_history
from tests.golden_values import HISTORY


def test_best_epoch_and_stop(spark):
    df = spark.createDataFrame([("bilstm", *[HISTORY[k] for k in
                                             ["train_loss", "val_loss", "val_f1_macro", "val_accuracy"]])],
                               "run string, train_loss array<double>, val_loss array<double>, "
                               "val_f1_macro array<double>, val_accuracy array<double>")
    th = training_history(history_rows(df))
    r = best_epochs(th).first()
    assert r["best_epoch"] == 7 and r["stop_epoch"] == 10 and r["epochs"] == 10
    assert abs(r["best_value"] - 0.885493) < 1e-6
