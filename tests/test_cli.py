import pytest

from pkgpulse.__main__ import parse_args


def test_parse_update_args():
    args = parse_args(
        ["update", "--root", "/w", "--feed", "package_requests_by_date=/in/a.csv", "--registry", "/r1.csv", "--registry", "/r2.csv", "--combine", "last"]
    )
    assert args.feeds == {"package_requests_by_date": "/in/a.csv"}
    assert args.registry == ["/r1.csv", "/r2.csv"] and args.combine == "last"


def test_unknown_feed_is_rejected():
    with pytest.raises(SystemExit):
        parse_args(["update", "--root", "/w", "--feed", "nope=/x.csv"])
